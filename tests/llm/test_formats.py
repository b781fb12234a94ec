"""Chat formatting, training order and WARC derivatives: exact round trips."""

import gzip
import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from solvara.llm import chat_format as cf
from solvara.llm import training_order as to
from solvara.llm import warc


def test_escape_round_trip():
    r = random.Random(1)
    bits = ["<", "|", "\\", "/", "s", ">", "[INST]", "[/INST]", "</s>", "<|end|>", "<<SYS>>", "<</SYS>>", "a", "\n", "é", "<|image:0|>", "INST]", "["]
    for _ in range(5000):
        t = "".join(r.choices(bits, k=r.randint(0, 8)))
        e = cf.escape(t)
        assert cf.unescape(e) == t and not any(c in e for c in cf.CONTROL)
        segment, spans, _ = cf.format_message("assistant", [{"type": "text", "text": t}])
        assert cf.read_segment(segment) == ("assistant", t)
        assert "".join(cf.unescape(segment[a:b]) for a, b in spans) == t


def test_parts_are_visited_in_order():
    parts = [
        {"type": "text", "text": "see <|image:9|>"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b.wav", "seconds": 1.01},
        {"type": "text", "text": None}, {"type": "document", "ref": "c.pdf", "pages": 3}, None, {"type": "video", "text": "as text"},
    ]
    segment, spans, found = cf.format_message("assistant", parts)
    assert [(a["position"], a["kind"], a["ref"], a["tokens"]) for a in found] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 26), (2, "document", "c.pdf", 1536)]
    assert segment.index("<|image:0|>") < segment.index("<|audio:1|>") < segment.index("<|document:2|>")
    assert cf.read_segment(segment) == ("assistant", "see <|image:9|>as text")
    assert "".join(cf.unescape(segment[a:b]) for a, b in spans) == "see <|image:9|>as text"
    assert cf.format_message("user", parts)[1] == []


def test_control_strings_across_parts():
    r = random.Random(2)
    bits = ["<", "|", "\\", "/", "s>", "</", "[IN", "ST]", "end|>", "<|", "|>x", "image:7", ":0|>", "", "<<S", "YS>>", None]
    for _ in range(3000):
        parts = [{"type": "text", "text": x} if r.random() < 0.8 else {"type": "image", "ref": "i", "width": 14, "height": 14} for x in r.choices(bits, k=r.randint(0, 6))]
        text = "".join(p.get("text") or "" for p in parts)
        segment, spans, found = cf.format_message("assistant", parts)
        assert cf.read_segment(segment) == ("assistant", text) and len(found) == sum(p["type"] == "image" for p in parts)
        assert "".join(cf.unescape(segment[a:b]) for a, b in spans) == text
        assert segment.count("<|") == 3 + len(found) and segment.endswith(cf.END)  # no mark but the template's own
    assert cf.format_message("user", [{"text": "<"}, {"text": "|end|>evil"}])[0] == "<|turn|>user<|says|><\\|end|>evil<|end|>"


def test_typed_parts_of_pages(spark):
    df = spark.createDataFrame([(1, "u", '<a href="/a">x</a><a href="b">y</a>', 0), (2, None, None, 0)], "page_id long, url string, html string, parts int")
    turns = cf.format_turns(cf.page_messages(df)).collect()
    one = next(t for t in turns if t.conv_id == 1 and t.turn == 0)
    assert one.segment == "<|turn|>user<|says|>u<|document:0|><|document:1|>What do these say?<|end|>" and one.expanded_tokens == 1024
    assert [a["ref"] for a in json.loads(one.attachments)] == ["/a", "b"]
    assert {t.conv_id: t.segment for t in turns if t.turn == 1} == {1: "<|turn|>assistant<|says|>2u<|end|>", 2: "<|turn|>assistant<|says|>0<|end|>"}


def test_digests(spark):
    rows = [(1, 2, "assistant", "B", 0), (1, 0, "system", None, 0), (1, 1, "user", "x" * 200_000, 0), (1, 2, "assistant", "A", 0), (None, None, None, "q", 0), (2, 0, "assistant", "</s>", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in cf.conversation_digests(cf.format_turns(cf.text_messages(df))).collect()}
    want = [("system", ""), ("user", "x" * 200_000), ("assistant", "A"), ("assistant", "B")]
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, hashlib.sha256(b"AB").hexdigest())
    assert got[None].turns_sha256 == hashlib.sha256(b"\nq\n").hexdigest() and got[None].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].loss_chars == 4
    assert cf.conversation_digests(cf.format_turns(cf.text_messages(df.limit(0)))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slot = to.feistel(np.arange(n), n)
    assert sorted(slot.tolist()) == list(range(n))
    assert (to.feistel(slot, n, inverse=True) == np.arange(n)).all()
    assert n < 16 or (to.feistel(np.arange(n), n, key=1) != slot).any()


def test_shards(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(["alpha", "beta", "x1", "…"]) for _ in range(r.choice([0, 1, 10, 90]))), 1) for k in range(70)] + [(70, None, 1), (None, "no id", 1), (3, "repeated", 1), (71, "word " * 20_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    shards = to.training_shards(df, seq_len=16, shard_slots=32)
    found = sorted(shards.collect(), key=lambda x: x.shard)
    encode = to.encoder(to.TOKENIZER)
    want = []
    for d, t, _ in rows:
        ids = [*encode(t or ""), to.END_ID]
        want += [(d, p, tuple(ids[s : s + 16] + [to.END_ID] * (16 - len(ids[s : s + 16])))) for p, s in enumerate(range(0, len(ids), 16))]
    got = []
    for k, s in enumerate(found):
        assert (s.shard, s.first_slot, s.record_bytes) == (k, 32 * k, 32) and s.n_slots == (32 if k < len(found) - 1 else len(want) - 32 * k)
        assert hashlib.sha256(s.payload).hexdigest() == s.payload_sha256 and len(s.payload) == 32 * s.n_slots
        table = np.frombuffer(s.payload, "<u2").reshape(-1, 16)
        got += [(d, p, tuple(row.tolist())) for d, p, row in zip(s.doc_ids, s.parts, table)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [g[:2] for g in got[:50]] != sorted((g[:2] for g in got[:50]), key=str)  # not in input order
    assert to.training_shards(df.limit(0)).count() == 0
    # files: the same records, read by their places
    path = str(tmp_path / "shards")
    assert to.write_shards(df, path, seq_len=16, shard_slots=32) == len(found)
    assert all((tmp_path / "shards" / to._name(x.shard)).read_bytes() == x.payload for x in found)
    part = sorted(to.read_slots(spark, path, 30, 66).collect(), key=lambda x: x.slot)
    assert [x.slot for x in part] == list(range(30, 67)) and all((x.doc_id, x.part, tuple(np.frombuffer(x.ids, "<u2").tolist())) == got[x.slot] for x in part)
    assert to.read_slots(spark, path, -5, 10**6).count() == len(got) and to.read_slots(spark, path, 10**6, 10**7).count() == 0


def test_each_slot_is_the_permuted_rank(spark):
    """Slots recomputed one by one: ranks from a plain sorted list, the permutation in whole numbers."""
    texts = [(k % 60, "word " * (k % 7 * 30)) for k in range(150)] + [(None, "no id"), (None, None), (3, None), (3, ""), (3, "")]
    seq_len, wide = 16, 2**64
    encode = to.encoder(to.TOKENIZER)
    listed = []
    for doc, text in texts:
        ids = [*encode(text or ""), to.END_ID]
        cut = [ids[k : k + seq_len] for k in range(0, len(ids), seq_len)]
        listed.append(((doc is not None, doc or 0, hashlib.sha256((text or "").encode()).digest()[:16]), doc, cut))
    flat = [(doc, part, ids) for _, doc, cut in sorted(listed, key=lambda x: x[0]) for part, ids in enumerate(cut)]
    n = len(flat)
    half = max(1, -(-(n - 1).bit_length() // 2))

    def mixed(x, key):
        x = (x + key) * 0x9E3779B97F4A7C15 % wide
        x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 % wide
        return x ^ (x >> 29)

    def slot(rank):
        while True:
            left, right = rank >> half, rank % 2**half
            for r in range(to.ROUNDS):
                key = int.from_bytes(hashlib.sha256(f"{to.KEY}:{r}".encode()).digest()[:8], "little")
                left, right = right, left ^ mixed(right, key) % 2**half
            rank = left << half | right
            if rank < n:
                return rank

    want = {slot(k): (doc, part, np.array(ids, "<u2").tobytes()) for k, (doc, part, ids) in enumerate(flat)}
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    placed, count, _ = to.placed_sequences(df, to.TOKENIZER, seq_len, 8, to.KEY, None)
    assert count == n and {r.slot: (r.doc_id, r.part, bytes(r.ids)) for r in placed.collect()} == want


def test_order_does_not_depend_on_partitions(spark, monkeypatch):
    r = random.Random(8)
    rows = [(r.randrange(12) if k % 3 else None, " ".join(r.choices(["a", "b", "c d e f g h"], k=r.choice([0, 1, 2, 30])))) for k in range(120)] + [(5, "same text " * 9)] * 60
    made = []
    for parts, limit in ((1, 4_000_000), (3, 4_000_000), (7, 0)):
        monkeypatch.setattr(to, "BROADCAST_DOCS", limit)
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found = to.training_shards(df, seq_len=8, shard_slots=16).collect()
        made.append({x.shard: (bytes(x.payload), tuple(x.doc_ids), tuple(x.parts)) for x in found})
    assert made[0] == made[1] == made[2] and len(made[0]) > 10


def test_interrupted_write_is_taken_up(spark, tmp_path):
    rows = [(k, f"text {k} " * (k % 20)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole, half = tmp_path / "whole", tmp_path / "half"
    args = {"seq_len": 16, "shard_slots": 16}
    n = to.write_shards(df.repartition(2), str(whole), **args)
    half.mkdir()
    for f in whole.iterdir():  # as a killed write leaves it: some shards, one cut, one under its first name
        k = to._NAME.search(f.name)
        if f.name == "_order.json" or k and int(k[1]) % 2:
            (half / f.name).write_bytes(f.read_bytes()[: 40 if k and int(k[1]) == 3 else None])
    (half / "shard-000000000004.bin.0abc.part").write_bytes(b"begun")
    wrote = to.write_shards(df.repartition(5), str(half), **args)
    assert wrote == n - (n // 2 - 1)
    names = [f.name for f in whole.iterdir() if f.suffix in (".bin", ".json")]
    assert all((half / x).read_bytes() == (whole / x).read_bytes() for x in names)
    assert to.write_shards(df, str(half), **args) == 0
    for other, options in ((df.where("doc_id > 0"), args), (df, args | {"key": 1}), (df, args | {"shard_slots": 8})):
        with pytest.raises(ValueError):
            to.write_shards(other, str(half), **options)
    with pytest.raises(FileNotFoundError):
        to.read_slots(spark, str(tmp_path / "none"), 0, 1)


PAGE = "<html lang=fr><head><title>A &amp; B</title><script>x()</script></head><body><a href='/p?q=1&amp;r=2'>go</a><p>One<b>two</b>\n three<div>four</div><a href=/p?q=1&r=2>again</a></body></html>"


def test_warc_derivatives(spark, tmp_path):
    rows = [(1, "http://h/x", PAGE, 5), (1, "http://h/x", PAGE, 5), (2, None, None, 5), (None, "http://h/[", "<p>" + "w " * 100_000, 5), (4, "http://h", "", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_id int")
    got = warc.page_derivatives(df).collect()
    assert len(got) == 2 * len(rows)
    one = {r.record_type: r for r in got if r.page_id == 1}
    assert one["metadata"].refers_to == one["conversion"].refers_to == warc.record_id("response", 1, "http://h/x")
    assert one["conversion"].text == "A & B\ngoOnetwo three\nfour\nagain".replace("goOne", "go\nOne")
    lines = one["metadata"].text.split("\r\n")
    assert "title: A & B" in lines and "language: fr" in lines and "source-content-type: text/html; charset=utf-8" in lines
    assert [x for x in lines if x.startswith("outlink")] == ["outlink: http://h/p?q=1&r=2 a/@href"]
    for r in got:
        assert r.block_digest == warc.sha1(r.text.encode()) and r.content_length == len(r.text.encode())
        assert r.source_digest.startswith("sha1:") and (r.target_uri is None) == (r.page_id == 2)
    assert one["conversion"].source_digest == warc.sha1(PAGE.encode())
    assert warc.page_derivatives(df.limit(0)).count() == 0
    responses = warc.page_responses(df)
    records = [(dict(r.headers), bytes(r.block)) for r in responses.collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.to_bytes(h, b) for h, b in records))
    back = [(dict(r.headers), bytes(r.block)) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert back == records
    again = warc.derivatives(warc.read_warc(spark, str(tmp_path)))
    assert sorted(r.record_id for r in again.collect()) == sorted(r.record_id for r in got)
    other = spark.createDataFrame([({"WARC-Type": "request"}, b"x"), (None, None)], warc.RECORD)
    assert warc.derivatives(other).count() == 0


def record(kind, block, extra=""):
    return f"WARC/1.0\r\nwarc-type: {kind}\r\nWarc-Record-Id: <urn:{len(block)}>\r\n{extra}content-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_broken_files_are_read_on(spark, tmp_path):
    one, two, three = record("response", b"first"), record("response", b"second block"), record("metadata", b"WARC/1.0 inside\r\n\r\nWARC/1")
    bad = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nabc\r\n\r\n"
    read = lambda data: [(h.get("WARC-Type"), b, p) for h, b, p in warc.from_bytes(data)]
    assert read(one + two) == [("response", b"first", ""), ("response", b"second block", "")]
    assert read(one + bad + three) == [("response", b"first", ""), ("response", b"", "no usable Content-Length"), ("metadata", b"WARC/1.0 inside\r\n\r\nWARC/1", "")]
    assert read(one + two[:-12]) == [("response", b"first", ""), ("response", two[:-12].split(b"\r\n\r\n")[1], "block is cut")]
    assert read(b"") == [] and read(b"\r\n\r\n" + one) == [("response", b"first", "")] and read(b"no warc at all") == []
    zipped = [gzip.compress(x, mtime=0) for x in (one, two, three)]
    assert [x[1] for x in read(b"".join(zipped))] == [b"first", b"second block", b"WARC/1.0 inside\r\n\r\nWARC/1"]
    assert [x[1] for x in read(gzip.compress(one + two + three))] == [b"first", b"second block", b"WARC/1.0 inside\r\n\r\nWARC/1"]
    spoilt = bytearray(b"".join(zipped))
    spoilt[len(zipped[0]) + 14 : len(zipped[0]) + 40] = b"\xff" * 26
    found = read(bytes(spoilt))
    assert [x[1] for x in found if not x[2]] == [b"first", b"WARC/1.0 inside\r\n\r\nWARC/1"] and len([x for x in found if x[2]]) == 1
    cut = read(b"".join(zipped)[:-20])
    assert [x[1] for x in cut if not x[2]] == [b"first", b"second block"] and len(cut) == 3
    for name, data in (("a.warc", one + bad), ("b.warc.gz", b"".join(zipped)[:-20]), ("c.warc", b"")):
        (tmp_path / name).write_bytes(data)
    report = {r.file.rsplit("/", 1)[-1]: (r.records, r.broken, len(r.problems)) for r in warc.warc_report(spark, str(tmp_path)).collect()}
    assert report == {"a.warc": (1, 1, 1), "b.warc.gz": (2, 1, 1)}
    assert warc.read_warc(spark, str(tmp_path)).count() == 3


def test_encoded_bodies():
    page = "<title>Té</title><p>one</p><p>two</p>".encode()
    chunks = b"".join(f"{len(x):x};n=1\r\n".encode() + x + b"\r\n" for x in (page[:7], page[7:])) + b"0\r\n\r\n"
    head = lambda *lines: ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + "".join(x + "\r\n" for x in lines) + "\r\n").encode()
    text = lambda block: warc.derive_record({"warc-type": "response", "warc-record-id": "<urn:x>"}, block)[1][1].decode()
    packed = gzip.compress(page)
    raw = zlib.compressobj(wbits=-15)
    for block in (
        head() + page, head("Transfer-Encoding: chunked") + chunks, head("Content-Encoding: gzip") + packed, head("content-encoding: deflate") + zlib.compress(page), head("Content-Encoding: deflate") + raw.compress(page) + raw.flush(),
        head("Transfer-Encoding: chunked", "Content-Encoding: gzip") + f"{len(packed):x}\r\n".encode() + packed + b"\r\n0\r\n\r\n",
    ):
        assert text(block) == "Té\none\ntwo"
    meta, conversion = warc.derive_record({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>"}, head("Content-Encoding: br") + b"\x0b\x02")
    assert conversion[1] == b"" and b"undecoded: br" in meta[1] and meta[0]["WARC-Refers-To"] == "<urn:x>"
    assert warc.dechunked(b"zz\r\nplain") == b"zz\r\nplain" and warc.dechunked(b"5\r\nab") == b"ab"


def test_charsets():
    assert warc.decode("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == ("é", "iso-8859-1")
    assert warc.decode(b"<meta charset=latin1>\xe9", "")[0].endswith("é")
    assert warc.decode(b"\xff", "text/html; charset=nonsense") == ("�", "utf-8")
    assert warc.derive_record({"WARC-Type": "response"}, b"no http head")[1][1] == b"no http head"
