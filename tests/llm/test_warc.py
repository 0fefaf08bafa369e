from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib

import pyarrow.fs as pafs
import pytest

from orrery.llm import warc as D
from orrery.llm.shared import cut, fresh_dir


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://x.example/{i}?q=é\r\n", f"<p>{i % 7}</p>\r\n\r\nWARC/1.1\r\n{'z' * (i * 40)}") for i in range(30)]
    rows += [(100 + i, "u", "the same") for i in range(20)] + [(200, None, None), (201, "u", ""), (None, "u", "the same"), (None, "u", "alone"), (300, "u", "twice"), (300, "u", "twice")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(4)


def test_query(pages):
    first = {}
    for r in pages.collect():
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    want = []
    for r in pages.collect():
        raw = (r.html or "").encode()
        one = first.get(r.html or "", r.page_id)
        again = one != r.page_id
        want.append((r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", one if again else None))
    assert sorted(map(tuple, D.warc_query(pages).collect()), key=repr) == sorted(want, key=repr)


def test_members_and_index_round_trip(spark, pages, monkeypatch):
    uri = fresh_dir(spark, "test")
    fs, path = pafs.FileSystem.from_uri(uri)
    whole = cut(D.write_archives(D.decide(pages), uri, archive_bytes=5000))
    members = cut(D.normalise(whole, uri))
    assert members.filter("error IS NOT NULL").count() == 0 and whole.count() >= 4
    old, new = b"", b""
    for r in whole.collect():
        old += gzip.decompress(fs.open_input_file(f"{path}/{r.archive}").read())
        data = fs.open_input_file(f"{path}/members-{r.archive}").read()
        new += gzip.decompress(data)
        index = [json.loads(x) for x in fs.open_input_file(f"{path}/members-{r.archive}.idx").read().splitlines()]
        assert index[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(index, index[1:], strict=False)) and index[-1]["offset"] + index[-1]["length"] == len(data)
        for e in index:
            alone = zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31)
            assert D.parse(alone)[0]["warc-record-id"] == e["id"] and alone.count(b"WARC-Record-ID") == 1
    assert old == new
    back = D.read_back(members, uri)
    assert back.count() == pages.count() and back.filter("NOT payload_ok").count() == 0


def test_small_payloads_are_all_responses(pages):
    assert D.decide(pages, least=9).filter("revisit AND octet_length(payload) < 9").count() == 0


def test_a_damaged_stream_keeps_the_records_before():
    records = [D.record(i, "u", b"x" * 5000 + bytes([i]), None, False) for i in range(5)]
    stream = gzip.compress(b"".join(records), 0)
    data, index, error = D.normalise_stream(io.BytesIO(stream[: len(stream) // 2]))
    assert error and len(index) == 2 and gzip.decompress(data) == b"".join(records[:2])
    data, index, error = D.normalise_stream(io.BytesIO(gzip.compress(b"".join(records[:2]) + b"garbage\r\n")))
    assert "no record" in error and len(index) == 2
    assert D.normalise_stream(io.BytesIO(gzip.compress(b""))) == (b"", [], None)


def test_archives_of_many_members_are_read_too():
    records = [D.record(i, None, b"p", None, False) for i in range(3)]
    data, index, error = D.normalise_stream(io.BytesIO(b"".join(gzip.compress(r) for r in records)))
    assert error is None and len(index) == 3


def test_empty_table(pages):
    assert D.warc_query(pages.filter("false")).count() == 0


def test_a_large_archive_passes_through_little_memory():
    """Fifty records of 2 MB; what is held is a record, not the archive."""
    import tracemalloc

    class Sink(io.RawIOBase):
        size = 0

        def write(self, data):
            self.size += len(data)
            return len(data)

    packed = gzip.compress(b"".join(D.record(i, "u", bytes([i]) * (2 << 20), None, False) for i in range(50)), 1)
    archive, index = Sink(), Sink()
    tracemalloc.start()
    n, error = D.normalise_into(io.BytesIO(packed), archive, index)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, error) == (50, None) and archive.size > 0 and index.size > 0 and most < 30 << 20


def test_very_large_and_hot_payloads(spark):
    rows = [(i, "u", "same") for i in range(40)] + [(100, "u", "z" * 5_000_000), (101, "u", "z" * 5_000_000), (102, None, None)]
    got = {r.page_id: r for r in D.warc_query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 43 and all(got[i].refers_to == 0 for i in range(1, 40)) and got[101].refers_to == 100 and got[101].payload_bytes == 5_000_000


def test_a_failure_of_the_store_is_no_damage():
    """A full disk, or a read that breaks off, is raised; it is not the end of the archive."""

    class Full(io.RawIOBase):
        def write(self, data):
            raise OSError(28, "No space left on device")

    class Broken(io.BytesIO):
        def read(self, size=-1):
            if self.tell() > 20_000:
                raise self.error
            return super().read(min(size, 4096) if size > 0 else 4096)

    packed = gzip.compress(b"".join(D.record(i, "u", b"x" * 5000, None, False) for i in range(9)), 0)
    for archive, index in ((Full(), io.BytesIO()), (io.BytesIO(), Full())):
        with pytest.raises(OSError, match="No space"):
            D.normalise_into(io.BytesIO(packed), archive, index)
    for error in (OSError(5, "Input/output error"), EOFError("cut off"), ValueError("closed")):
        source = Broken(packed)
        source.error = error
        with pytest.raises(type(error)) as found:
            D.normalise_into(source, io.BytesIO(), io.BytesIO())
        assert found.value is error


@pytest.mark.parametrize("what", ["truncated", "emptied", "changed"])
def test_the_query_fails_on_a_damaged_archive(pages, monkeypatch, what):
    landed = D.landed

    def damaged(df, uri, name):
        out = landed(df, uri, name)
        if name == "whole":
            fs, path = pafs.FileSystem.from_uri(uri)
            file = f"{path}/{out.orderBy('archive').first().archive}"
            data = fs.open_input_file(file).read()
            raw = gzip.decompress(data)
            data = {"truncated": data[: len(data) // 2], "emptied": gzip.compress(b""), "changed": gzip.compress(raw.replace(b"<p>", b"<q>"))}[what]
            with fs.open_output_stream(file, compression=None) as f:
                f.write(data)
        return out

    monkeypatch.setattr(D, "landed", damaged)
    with pytest.raises(Exception, match="records of|as it was written"):
        D.warc_query(pages).collect()
