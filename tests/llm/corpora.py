"""Small corpora for brute-force tests."""

import random

ODD = [
    (900, None, "en", "s", 0),
    (901, "", "en", "s", 0),
    (902, " \t\n\r\x0b\x0c ", "en", "s", 6),
    (903, "word", None, None, None),
    (904, "a " * 3000, "en", "s", 6000),
    (905, "Ünïcödé \x00 \x1c   text ΣΑΣ İ <|endoftext|> don't 12345 ...", "de", "s", 60),
    (906, "line\nline\n\nline", "en", "s", 15),
    (907, "x" * 5000, "en", "s", 5000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random prose with exact copies, near copies and a passage that many documents share."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghié", k=r.randint(1, 9))) for _ in range(300)]
    passage = " ".join(r.choices(words, k=60))
    out = []
    for i in range(n):
        kind = r.random()
        text = " ".join(r.choices(words, k=r.choice([3, 30, 80, 400])))
        if out and kind < 0.15:
            text = r.choice(out)[1]
        elif out and kind < 0.4:
            w = r.choice(out)[1].split(" ")
            w[r.randrange(len(w))] = "CHANGED"
            text = " ".join(w)
        elif kind < 0.6:
            text = f"{text} {passage}\n{r.choice(words)}"
        out.append((i, text, "en", f"src{i % 3}", len(text)))
    return out + ODD


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
