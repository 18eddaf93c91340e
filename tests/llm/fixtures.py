"""Small corpora with every odd case, and plain-Python words."""

import random
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return ALNUM.findall((text or "").translate(UPPER))


def corpus(n=60, seed=3):
    """(doc_id, text): prose, copies, near copies, shared passages, null, empty, odd and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñtrs") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = prose(70), "a line that many documents share: " + prose(4)
    texts = []
    for i in range(n):
        text = prose(rng.randint(1, 160))
        if i % 6 == 1 and texts:
            text = rng.choice(texts)
        elif i % 6 == 2 and texts:
            parts = rng.choice(texts).split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        elif i % 6 == 3:
            text = f"{text}\n{line}\n{passage}\n{prose(9)}"
        elif i % 6 == 4:
            text = f"{prose(5)}.\n  {line.upper()} \t\n{line}\n{text}"
        texts.append(text)
    texts += ["", "", "   \n\t", "!!! ???", "ab", "one two three", "x" * 5000, prose(3000), "é́ ﬁ ①", "日本語 テキスト", "a\r\nb\rc", "<|endoftext|> is text", "\x00 nul \x00"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(9000, None), (9001, None)]
    return rows


def frame(spark, rows, extra=True):
    """documents with columns whose names clash with results."""
    data = [(i, t, "xx", "src", len(t or ""), 7, "v", 1.5) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, fp string, score double"
    df = spark.createDataFrame(data, schema)
    return df if extra else df.select("doc_id", "text")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
