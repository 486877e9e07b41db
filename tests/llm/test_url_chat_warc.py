"""URL filters, chat formatting and WARC archives."""

import base64
import gzip
import hashlib
import io
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidyframe.llm import chat, components, url_filter, warc


def test_vocabulary_boundaries():
    judge = lambda u: url_filter.rejected(u, ("xxx", "free-bets"), ("adult", "bet", "casino"), 2)
    assert judge("http://a.org/XXX/1") and judge("http://free-bets.org") and judge("xxx")
    assert not judge("http://axxxb.org/") and not judge("http://a.org/xxx1") and not judge("http://a.org/bet/bet")
    assert judge("http://bet.org/casino") and not judge("http://bets.org/casino") and not judge("")


def test_rules(spark):
    urls = [("http://a.COM/x", "com/"), ("http://a.com", None), ("https://sub.example.com/en/1", "example.com/en/"), ("http://WWW.example.com/en/", "www.example.com/en/"), ("http://m.www.example.com/en/?q", "www.example.com/en/"), ("http://b.net/es/1#x", "net/es/"), ("http://net/fr/", "net/fr/"), ("http://xnet/fr/", None), ("a.com/en/", None), (None, None), ("", None), ("http://a.org/?u=http://b.com/", None), ("x://a.com/\n", "com/")]
    df = spark.createDataFrame([(i, u, "extra") for i, (u, _) in enumerate(urls)], "page_id bigint, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert [got[i].rule for i in range(len(urls))] == [r for _, r in urls]
    assert [got[i].verdict for i in (0, 2, 3, 5, 8, 9)] == ["allow", "block", "allow", "block", "allow", "allow"]
    assert (got[8].host, got[8].path, got[12].path) == ("", "", "/\n")
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_odd_urls(spark):
    """Repeated rows, a very long URL, terms beyond the rules, and rules that settle what holds terms."""
    rows = [(1, "http://payday-loans.org/"), (1, "http://payday-loans.org/"), (2, "http://a.org/" + "x/" * 500_000 + "casino/slots"), (3, "http://casino-porn.com/"), (4, "http://gambling.org/free"), (5, "http://library.org/free")]
    got = [(r.page_id, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()]
    assert sorted(got) == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "block"), (5, "allow")]


def test_odd_chats(spark):
    """An empty table, repeated and tied rows, a very long text and further columns."""
    rows = [(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (2, 0, "assistant", "long </turn> " * 100_000, "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, formatted string").withColumn("content", chat.text_part(F.col("text")))
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [t.text for t in got[1].read_turns] == ["a", "a", "b"] and got[1].loss_text == ""
    assert got[2].loss_text == "long </turn> " * 100_000 == got[2].read_turns[0].text
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chats_of_many_turns(spark):
    """Work grows with the turns, not their square: 20,000 of them take less than eight times as long as 5,000."""
    def seconds(n):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("two words é "), F.col("id").cast("string")).alias("text"))
        began = time.perf_counter()
        (r,) = chat.read_chats(chat.format_chats(turns.withColumn("content", chat.text_part(F.col("text"))))).collect()
        assert len(r.read_turns) == n and r.loss_text == "".join(f"two words é {i}" for i in range(1, n, 2))
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 8 * max(seconds(5_000), 0.7)


def test_loss_spans_that_meet_no_text(spark):
    made = chat.format_chats(spark.createDataFrame([(1, 0, "assistant", "said")], "conv_id int, turn int, role string, text string").withColumn("content", chat.text_part(F.col("text"))))
    moved = made.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["end"].alias("end"))))
    with pytest.raises(Exception, match="no turn's text"):
        chat.read_chats(moved).collect()
    read = chat.read_chats(made.withColumn("formatted", F.lit(None).cast("string")).withColumn("loss_spans", F.lit(None).cast("array<struct<start:bigint,end:bigint>>"))).collect()
    assert [(r.conv_id, r.read_turns, r.loss_text) for r in read] == [(1, [], "")]


def test_clashing_columns_in_archives(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "h", "d", "s"), (2, "u", "h", "d", "s")], "page_id bigint, url string, html string, digest string, _refers string")
    warc.write_warc(df, path := str(tmp_path / "w"))
    assert sorted(r.record_type for r in warc.read_warc(spark, path).collect()) == ["response", "revisit"]


TEXT = st.lists(st.sampled_from([*"#</turn>\\ :|image\n", "### ", "</turn>", "<|image|>", "é", "### ", "\\"]), max_size=12).map("".join)


def test_round_trip(spark):
    cases = []

    @settings(max_examples=300, deadline=None, database=None, derandomize=True)
    @given(st.lists(st.tuples(TEXT, st.one_of(st.none(), TEXT)), min_size=1, max_size=4))
    def gather(turns):
        cases.append(turns)

    gather()
    rows = [(i, t, role, text) for i, turns in enumerate(cases) for t, (role, text) in enumerate(turns)] + [(i, 99, "assistant", f"answer {i} ###") for i in range(len(cases))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    for r in chat.read_chats(chat.format_chats(df.withColumn("content", chat.text_part(F.col("text"))))).collect():
        want = [(role, text or "") for role, text in cases[r.conv_id]] + [("assistant", f"answer {r.conv_id} ###")]
        assert [(t.role, t.text) for t in r.read_turns] == want
        assert r.loss_text == "".join(t for role, t in want if role == "assistant")


def test_typed_parts(spark):
    part = "struct<type: string, text: string, ref: string, tokens: bigint>"
    rows = [(1, 0, "user", [("text", "see ", None, None), ("image", None, "i.png", 64), ("text", " <|image|>", None, 0), ("document", "d", "d.pdf", None)]), (1, 1, "assistant", [("audio", None, "a.wav", 8)]), (2, 0, None, None), (None, None, "user", [])]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, f"conv_id bigint, turn int, role string, content array<{part}>")).collect()}
    assert [(a.type, a.ref, a.tokens) for a in got[1].attachments] == [("image", "i.png", 64), ("document", "d.pdf", 0), ("audio", "a.wav", 8)]
    assert got[1].attachment_tokens == 72 and got[1].formatted == "### user: see <|image|> <\\|image|><|document|></turn>### assistant: <|audio|></turn>"
    s = got[1].loss_spans[0]
    assert got[1].formatted[s.start : s.end] == "<|audio|>" and got[2].formatted == "### : </turn>" and got[None].formatted == "### user: </turn>"


def pages(spark):
    hot = "same é " * 50
    rows = [(i, f"http://h/{i}\r\nWARC-Type: x", hot) for i in range(300)] + [(400, None, None), (401, "u", ""), (402, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n\r\n"), (403, "u", "z" * 2_000_000), (404, "u", "tail"), (404, "u", "tail")]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)


def test_warc_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    warc.write_warc(df, path := str(tmp_path / "w"))
    got = warc.read_warc(spark, path)
    assert got.count() == len(rows)
    by = {r.record_id: r for r in got.collect()}
    texts = {f"<urn:page:{i}>": (t or "").encode() for i, _, t in rows}
    for rid, r in by.items():
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(texts[rid]).digest()).decode() and int(r.payload_length) == len(texts[rid])
        assert r.payload == (texts[rid] if r.record_type == "response" else None)
    assert [i for i in range(300) if by[f"<urn:page:{i}>"].record_type == "response"] == [299]
    assert by["<urn:page:400>"].refers_to == "<urn:page:401>" and by["<urn:page:400>"].target_uri is None and by["<urn:page:5>"].refers_to == "<urn:page:299>"


def test_warc_predicates(spark, tmp_path):
    rows, df = pages(spark)
    warc.write_warc(df, path := str(tmp_path / "w"), compression="none", archive_bytes=10_000)
    got = warc.read_warc(spark, path)
    assert got.filter("record_type = 'revisit'").count() == 300
    assert got.filter("record_id in ('<urn:page:402>', '<urn:page:7>') and target_uri is not null").count() == 2
    assert got.filter("target_uri is null").count() == 1 and got.filter("record_type <> 'revisit'").count() == 6
    assert warc.read_warc(spark, path, payload=False).filter("payload is not null").count() == 0
    assert all(r.payload_length == "4" for r in got.filter("payload = cast('tail' as binary)").collect())
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"x")]))
    assert len(left) == 1 and len(reader.filters) == 1 and len(warc.WarcReader({"path": path, "partitionbytes": "1"}).partitions()) > 1


def test_warc_limits(spark, tmp_path):
    _, df = pages(spark)
    warc.write_warc(df, path := str(tmp_path / "w"), least_bytes=5)
    got = warc.read_warc(spark, path)
    assert got.filter("record_id in ('<urn:page:400>', '<urn:page:401>', '<urn:page:404>') and record_type = 'response'").count() == 4
    warc.write_warc(df.limit(0), empty := str(tmp_path / "e"))
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_members(spark, tmp_path):
    """A member for each record, archives bounded by bytes, payloads that are not asked for neither read nor inflated."""
    rows, df = pages(spark)
    warc.write_warc(df, path := str(tmp_path / "w"), archive_bytes=2_000)
    files = sorted(tmp_path.glob("w/*.warc.gz"))
    assert len(files) > 4 and not list(tmp_path.glob("w/_temporary*/*"))
    whole = [gzip.decompress(f.read_bytes()) for f in files]  # other readers open them as ordinary gzip
    assert sum(w.count(b"WARC-Record-ID: ") for w in whole) == len(rows)
    assert sorted(r.record_id for r in warc.read_warc(spark, path).collect()) == sorted(f"<urn:page:{r[0]}>" for r in rows)
    size = 3_000_000
    noise = np.random.default_rng(0).bytes(size)
    member = lambda n, block: warc._member(f"WARC/1.1\r\nWARC-Type: {n}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    plain = gzip.compress(b"WARC/1.1\r\nWARC-Type: last\r\nContent-Length: 3\r\n\r\nend\r\n\r\n")
    data = member("a", noise) + member("b", b"x" * size) + member("c", b"short") + plain

    class Counted(io.BytesIO):
        read_bytes = 0

        def readinto(self, b):
            n = super().readinto(b)
            Counted.read_bytes += n
            return n

    assert [h["warc-type"] for h, _ in warc._records(io.BufferedReader(Counted(data), warc.READ_BYTES))] == ["a", "b", "c", "last"]
    assert Counted.read_bytes < size / 5
    blocks = [take() for _, take in warc._records(io.BufferedReader(io.BytesIO(data)))]
    assert blocks == [noise, b"x" * size, b"short", b"end"]
    with pytest.raises(EOFError):
        [take() for _, take in warc._records(io.BufferedReader(io.BytesIO(data[: size // 2])))]
    with pytest.raises(zlib.error):
        bad = bytearray(member("a", b"short"))
        bad[-6] ^= 1
        [take() for _, take in warc._records(io.BufferedReader(io.BytesIO(bytes(bad))))]


def test_warc_hot_payload(spark, tmp_path, monkeypatch):
    """Payloads met by join and by broadcast."""
    for hot in (1, 20_000):
        monkeypatch.setattr(components, "HOT", hot)
        rows = spark.createDataFrame([(i, "d" if i % 3 else f"d{i}", 9) for i in range(30)] + [(None, "d", 9), (40, "s", 2), (41, "s", 2)], "id bigint, digest string, size bigint")
        got = {(r.id, r.digest): r.refers_to for r in warc.revisits(rows, 5).collect()}
        assert len(got) == 33 and all(v == (29 if d == "d" and i != 29 else None) for (i, d), v in got.items())
