import random

import pytest

from seqloom.llm import queries, warc
from seqloom.llm.warc import Gap, Record, base32_sha1, record_bytes, salvage


def test_query_and_sql(spark, duck, same, sf_dir):
    same(queries.op5_warc(spark, sf_dir).toPandas(), duck.sql(queries.OP5_SQL).df())


def archive(n, compress=True):
    return [record_bytes(i, f"http://x/{i}", (f"<p>{i}</p>" * (i + 1)).encode(), base32_sha1((f"<p>{i}</p>" * (i + 1)).encode()), compress=compress) for i in range(n)]


@pytest.mark.parametrize("compress", [True, False])
def test_whole_archive(compress):
    got = list(salvage(b"".join(archive(5, compress))))
    assert len(got) == 5 and all(isinstance(r, Record) for r in got)
    assert [r.payload for r in got] == [(f"<p>{i}</p>" * (i + 1)).encode() for i in range(5)]


@pytest.mark.parametrize("compress", [True, False])
def test_damage_is_one_gap_and_the_rest_survives(compress):
    rng = random.Random(4)
    parts = archive(9, compress)
    for k in range(len(parts)):
        own = parts[k]
        for broken in (own[: len(own) // 2], own[:20] + bytes(60) + own[80:], b"junk" + own[6:], own[:-3]):
            data = b"".join(parts[:k]) + broken + b"".join(parts[k + 1 :])
            got = list(salvage(data))
            records, gaps = [r for r in got if isinstance(r, Record)], [g for g in got if isinstance(g, Gap)]
            assert [r.headers["warc-record-id"] for r in records] == [f"<urn:page:{i}>" for i in range(9) if i != k]
            start = sum(map(len, parts[:k]))
            assert [(g.start, g.end) for g in gaps] == [(start, start + len(broken))] and gaps[0].reason
    assert list(salvage(b"")) == [] and len(list(salvage(rng.randbytes(500)))) == 1


def test_wrong_digest_is_quarantined():
    plain = archive(3, False)
    plain[1] = plain[1].replace(b"<p>1</p>", b"<p>7</p>")
    kinds = [type(x).__name__ for x in salvage(b"".join(plain))]
    assert kinds == ["Record", "Gap", "Record"]


def test_revisits_ties_and_edges(spark):
    rows = [(3, "u", "same", "x"), (1, "u", "same", "x"), (2, None, "same", "x"), (4, "u", None, "x"), (5, "a\nb\x00\u2028é:", "", "x"), (6, "u", "é" * 1000, "x"), (1, "u", "same", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df)[0].where("gap_end is null").collect())
    assert got == [(1, 4, "response", None), (1, 4, "response", None), (2, 4, "revisit", 1), (3, 4, "revisit", 1), (4, 0, "response", None), (5, 0, "revisit", 4), (6, 2000, "response", None)]
    few = [r["record_type"] for r in warc.round_trip(df, least=5)[0].collect()]
    assert few == ["response"] * 7
    assert warc.round_trip(df.limit(0))[0].count() == 0


def test_read_by_spark(spark, tmp_path):
    parts = archive(4)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"noise" + parts[1])
    (tmp_path / "b.warc").write_bytes(b"".join(archive(2, False)))
    rows = warc.read_warc(spark, str(tmp_path / "*.warc*")).collect()
    assert sorted((r["page_id"]) for r in rows if r["gap_end"] is None) == [0, 0, 1, 1]
    assert [(r["offset"], r["gap_end"]) for r in rows if r["gap_end"]] == [(len(parts[0]), len(parts[0]) + 5)]


def test_records_of_a_damaged_member_survive():
    import gzip

    plain = archive(6, False)
    pages = lambda data: [r.headers["warc-record-id"] for r in salvage(data) if isinstance(r, Record)]
    ids = [f"<urn:page:{i}>" for i in range(6)]
    broken = b"".join([*plain[:2], plain[2].replace(b"<p>2</p>", b"<p>9</p>", 1), *plain[3:]])
    got = list(salvage(gzip.compress(broken)))
    assert [type(r).__name__ for r in got] == ["Record", "Record", "Gap", "Record", "Record", "Record"]
    assert pages(gzip.compress(broken)) == ids[:2] + ids[3:]
    rng = random.Random(5)
    plain = [record_bytes(i, "u", x, base32_sha1(x), compress=False) for i, x in enumerate(rng.randbytes(3000) for _ in range(6))]
    member = gzip.compress(b"".join(plain))
    tail = archive(1)[0]
    for cut in (member[: len(member) * 3 // 4], member[: len(member) * 3 // 4] + tail):
        got = pages(cut)
        assert got[:4] == ids[:4] and got[4:] == ids[:1] * cut.endswith(tail)
        assert any(isinstance(r, Gap) for r in salvage(cut))


def test_digests_in_lower_case_or_hex():
    import hashlib

    plain = archive(1, False)[0]
    block = next(iter(salvage(plain))).block
    own = base32_sha1(block).encode()
    head, body = plain.split(b"\r\n\r\n", 1)
    for other in (own.lower(), hashlib.sha1(block).hexdigest().encode()):
        i = head.lower().index(b"warc-block-digest")
        changed = head[:i] + head[i:].replace(own, other, 1)
        assert other in changed and isinstance(next(iter(salvage(changed + b"\r\n\r\n" + body))), Record)


def test_very_long_payloads_and_bounded_batches():
    big = b"x" * (1 << 20)
    data = b"".join(record_bytes(i, f"http://x/{i}", big, base32_sha1(big)) for i in range(5))
    got = list(warc._rows("p", data, True, most=2 << 20))
    assert [b.num_rows for b in got] == [2, 2, 1] and all(r["payload"] == big for b in got for r in b.to_pylist())


def test_read_back_has_a_task_for_each_archive(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string").repartition(5)
    out = warc.shared_dir(spark, "warc")
    manifest = warc.write_archives(df, out)
    rows = warc.read_archives(manifest, out)
    assert rows.rdd.getNumPartitions() == manifest.count() and rows.count() == 40
