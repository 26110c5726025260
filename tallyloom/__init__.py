"""tallyloom: company-research analytics as plain Spark DataFrame functions."""
