"""Each stage of the pipeline against a brute-force version, on its own input."""

from __future__ import annotations

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from common import SF
from test_decontaminate import brute as contamination
from test_packing import _ids
from test_repeats import PATTERN
from test_repeats import brute as repeats
from test_simhash import groups

import corpus_pipeline as C
from orrery.llm import toxicity


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_keep_the_columns(stages):
    assert len(C.STAGES) == 5 and all(s.dtypes == stages[0].dtypes for s in stages[:5])


def test_toxicity(spark, stages):
    classifier = toxicity.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    rows = _texts(stages[0])
    scores = dict(zip(rows, classifier.scores(pa.array(rows.values())), strict=True))
    assert set(_texts(stages[1])) == {k for k, s in scores.items() if s < 0.5} and len(_texts(stages[1])) < len(rows)


def test_near_copies(stages):
    rows = _texts(stages[1])
    sets = {}
    for k, t in rows.items():
        w = PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    part = groups([(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], list(sets))
    assert set(_texts(stages[2])) == set(part.values())


def test_repeats(stages):
    want = {k: x for k, n, gone, x in repeats(list(_texts(stages[2]).items()), 13) if not gone or gone < n}
    assert {k: PATTERN.findall(t or "") for k, t in _texts(stages[3]).items()} == want
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_contamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = _texts(stages[3])
    assert _texts(stages[4]) == {k: t for k, t in rows.items() if not contamination(t, items)[1]}


def test_packing(stages):
    rows = _texts(stages[4])
    length = collections.Counter()
    for r in stages[5].collect():
        length[r.doc_id] += r.length
    assert length == {k: len(_ids(t)) // 4 + 1 for k, t in rows.items()}
    used = collections.Counter()
    for r in stages[5].collect():
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and np.mean(list(used.values())) > 900


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    assert key(C.run(spark, SF)) == key(stages[5])


def test_awkward_rows_pass_all_stages_whatever_the_partitions(spark, tmp_path):
    """Null ids, repeated ids and rows, null, empty and long texts, clashing columns; the same result for any number of partitions."""
    import random

    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [" ".join(word() for _ in range(rng.randint(5, 80))) for _ in range(40)]
    texts[7] = texts[3]
    texts[9] = texts[4] + " " + word()
    texts[11] = f"  {texts[11]}\t{texts[5]}  "
    item = " ".join(word() for _ in range(12))
    texts[13] += " " + item
    texts += [None, "", " \n ", " ".join(word() for _ in range(8000)), "dreck " * 3 + texts[0][:20]]
    rows = [(i, t, "en", "s", len(t or ""), i, "own") for i, t in enumerate(texts)]
    rows += [(None, texts[2], "en", "s", 1, 1, None), (6, "another text of the sixth document with words of its own", "de", "t", 2, 2, None), rows[8], (20, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mark long, own string"
    spark.createDataFrame([(i, int(i == len(texts) - 1)) for i in range(0, len(texts), 2)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", item), (None, None), ("b", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = []
    for parts in (1, 3, 17):
        docs = spark.createDataFrame(rows, schema).repartition(parts)
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents{parts}")
        docs = spark.read.parquet(f"{tmp_path}/documents{parts}")
        for k, (_, stage) in enumerate(C.STAGES[:4]):
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes
            out.write.parquet(f"{tmp_path}/{parts}_{k}")
            docs = spark.read.parquet(f"{tmp_path}/{parts}_{k}")
        found.append(sorted((tuple(r) for r in docs.collect()), key=repr))
        packed = C.pack(spark, docs, str(tmp_path)).collect()
        assert sum(r.length for r in packed) == sum(len(_ids(r[1] or "")) // 4 + 1 for r in found[-1])
    assert found[0] == found[1] == found[2]
    kept = {(r[0], r[1]) for r in found[0]}
    ids = [k for k, _ in kept]
    assert None in ids and 6 in ids and 7 not in ids and 9 not in ids and 13 not in ids
    assert ids.count(6) == 2 and sum(r[0] == 8 for r in found[0]) == 1
    gone = next(t for k, t in kept if k == 11)
    assert gone.startswith("  ") and texts[5] not in gone


def test_empty_tables_pass_all_stages(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
