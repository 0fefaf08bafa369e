from __future__ import annotations

import random

import pytest


@pytest.fixture
def corpus(spark):
    """Documents with nulls, empty and long texts, copies, shared passages, repeated rows, and columns with awkward names."""
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 5 == 0 else f"w{i}" for i in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=20))
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(40)]
    texts[3] = texts[1]
    texts[7] = texts[2] + " tail"
    texts[9] = f"{texts[9]}\n{passage}\tand {passage}"
    texts[20] = f"{passage}  {texts[20]}"
    texts += ["", None, "   \n ", " ".join(rng.choices(vocabulary, k=5000)), "x" * 20000, "Ä ß İ <|endoftext|> 漢字", "a a a a a a a a a a a a a a a a a a", None]
    rows = [(i, t, "en", "s", len(t or ""), i % 3, "kept", 1.5) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[6], "en", "s", 1, 0, "null id", None), (12, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, own string, score double"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture
def nothing(corpus):
    return corpus.filter("false")
