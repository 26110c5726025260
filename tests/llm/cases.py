"""Documents for small tests: nulls, empties, repeats, ties, a long text, clashing extra columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, uid string, _row_key string, _score string, _file string, digest string, rank string, tail string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) + str(rng.randint(0, 60)) for _ in range(n))


def documents(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(20, 200)) for _ in range(20)]
    texts = [None, None, "", " ", "one", "two words", "é漢字 \u0000 x", "x <|endoftext|> y", "\n\t a\u001cb  c \n"]
    texts += base + base[:5] + [base[0].replace(" ", "\n\t")]
    for t in base[5:12]:  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [prose(rng, 30) + " " + base[3][:260] + " " + prose(rng, 30) for _ in range(3)]  # a shared passage
    texts += ["ab" * 400, "ab" * 500, "x" * 199, "x" * 200, "x" * 201, base[7] * 40]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, "no id"), (None, "no id"), (100, "twice"), (100, "twice")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "l", "u", "k", "s", "f", "d", "r", "t") for i, t in rows], SCHEMA)


def unique(rows):
    """Rows whose id is given and occurs once."""
    ids = [i for i, _ in rows]
    return [(i, t) for i, t in rows if i is not None and ids.count(i) == 1]
