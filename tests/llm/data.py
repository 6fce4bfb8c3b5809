"""Small documents with the cases that operators have to bear."""

import random

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, body string, grp long, size long, spans string, keys string"


def rows(n=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for i in range(n):
        kind = i % 6
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 90)))
        if kind == 1 and texts:
            text = texts[-1]
        if kind == 2 and texts:
            parts = texts[-1].split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        if kind == 3:
            text += "\n" + passage + "\n" + text[:40]
        if kind == 4:
            text += f" mail a.b{i % 3}@x-y.example.com, ip 10.0.0.{i} 300.1.1.1 card 4111 1111 1111 1111 tel +1 (200) 555-01{i:02d} end <|endoftext|> ▁ It's"
        texts.append(text)
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "x" * 30000), (1005, " " * 700 + "y"), (None, texts[0]), (7, texts[7]), (1006, "a@b.c%d@e.f 1.2.3.4.5.6.7.8 " + "1 " * 40 + "+" + "2" * 12), (1007, "\x00 nul   line")]
    return [(i, t, [None, "a", "b", "ü"][k % 4], "en", 1, "clash", 5, 9, "clash", "clash") for k, (i, t) in enumerate(out)]


def frame(spark, n=60):
    return spark.createDataFrame(rows(n), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
