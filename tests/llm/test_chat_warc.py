import gzip
import hashlib
import io
import json

import pytest
from hypothesis import given, settings, strategies as st

from lekhya.llm import chat, warc

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "]", "[", "<", "/", " ", "\n", "ok", "é",
                                   "\U0001f600"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool]"]) | PIECES,
                          PIECES), max_size=6))
def test_rendering_reads_back(turns):
    parts = ["".join(chat.render(r, t)) for r, t in turns]
    assert chat.parse("".join(parts)) == turns
    for (_, text), part in zip(turns, parts):
        assert not chat._CONTROL.search(chat.escape(text))
        assert chat.unescape(chat.escape(text)) == text


def test_layouts_meet_in_canonical_turns(spark):
    records = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "q"},
                                    {"role": "assistant", "content": None}]},
        {"conv_id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"conv_id": 3, "prompt": "q", "response": "a"},
        {"conv_id": 4, "instruction": "do", "input": "this", "output": "a"},
        {"conv_id": 5, "instruction": "do", "output": "a"},
        {"conv_id": 6, "turn": 3, "role": None, "text": "t"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [(None,)], "record string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(df).collect())
    assert got == [("1", 0, "user", "q"), ("1", 1, "assistant", ""), ("2", 0, "user", "q"),
                   ("2", 1, "assistant", "a"), ("3", 0, "user", "q"), ("3", 1, "assistant", "a"),
                   ("4", 0, "user", "do\n\nthis"), ("4", 1, "assistant", "a"),
                   ("5", 0, "user", "do"), ("5", 1, "assistant", "a"), ("6", 3, "", "t")]
    assert chat.rejected(df).count() == 0
    assert chat.read_back(chat.formatted(chat.canonical_turns(df.limit(0)))).count() == 0


def test_odd_records_are_read_or_rejected_one_by_one(spark):
    fine = [{"conv_id": "a-1", "messages": [{"role": "user", "content": "q", "name": "n"},
                                            {"role": "assistant", "content": "a"}]},
            {"conv_id": 1, "messages": []}, {"conv_id": 2, "messages": None},
            {"conv_id": None, "prompt": "p", "response": "r"}]
    odd = ['{"conv_id": 1, "other": 2}', "{", "", "[]", "7", "null",
           '{"conv_id": 1, "prompt": 5, "response": "r"}',
           '{"conv_id": 1, "turn": "x", "role": "user", "text": "t"}',
           '{"conv_id": 1, "turn": 99999999999999999999, "role": "user", "text": "t"}',
           '{"conv_id": 1, "messages": [{"role": "user", "content": ["t"]}]}',
           '{"conv_id": 1, "messages": [{"role": "user", "content": "t"}, 4]}', "[" * 100_000]
    lines = [json.dumps(r) for r in fine] + odd + [odd[0], None]
    df = spark.createDataFrame([(line, 1) for line in lines], "record string, problem int")
    got = [(r.conv_id, r.turn, r.part, r.role, r.text) for r in chat.canonical_turns(df).collect()]
    assert got == [("a-1", 0, 0, "user", "q"), ("a-1", 1, 1, "assistant", "a"),
                   (None, 0, 0, "user", "p"), (None, 1, 1, "assistant", "r")]
    left = chat.rejected(df).collect()
    assert sorted(r.record for r in left) == sorted([*odd, odd[0]])
    assert all(r.problem for r in left)
    assert "no mapping for layout ['.conv_id', '.other']" in {r.problem for r in left}


def test_digests(spark):
    turns = [("1", 1, 0, "assistant", "a\\b<s>"), ("1", 0, 0, "user", None or ""), ("1", 2, 0, "tool", "x"),
             (None, 0, 0, "user", "n")]
    df = spark.createDataFrame(turns, chat.TURNS)
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    want = hashlib.sha256("user\n\nassistant\na\\b<s>\ntool\nx\n".encode()).hexdigest()
    assert (got["1"].n_turns, got["1"].turns_sha256, got["1"].loss_chars) == (3, want, 6)
    assert got["1"].loss_sha256 == hashlib.sha256(b"a\\b<s>").hexdigest()
    assert got[None].n_turns == 1 and got[None].loss_chars == 0


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nx", "é" * 80), (2, None, "é" * 80), (3, "u", "short"), (4, "u", "short"),
            (5, "u", None), (6, "u", "y" * 3_000_000), (None, "u", "null id" * 40), (2, None, "é" * 80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index, folder = warc.archive(df, str(tmp_path / "w"))
    index = index.cache()
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest)
                  for r in warc.read_indexed(index, folder).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted(((p or 0, "revisit" if p == 2 else "response", 1 if p == 2 else None,
                    len((t or "").encode()), sha(t)) for p, _, t in rows), key=str)
    assert got == want
    # every record is a member of its own, at the offset of the index and of the sidecar
    for r in index.collect():
        data = open(f"{folder}/{r.file}", "rb").read()
        member = gzip.decompress(data[r.offset:r.offset + r.length])
        assert member.startswith(b"WARC/1.1\r\n") and member.count(b"WARC/1.1\r\n") == 1
        lines = [json.loads(x) for x in open(f"{folder}/{r.file}.cdxj")]
        assert (r.offset, r.length) in {(x["offset"], x["length"]) for x in lines}
    empty, where = warc.archive(df.limit(0), str(tmp_path / "e"))
    assert warc.read_indexed(empty, where).count() == 0


def test_normaliser_reads_any_members_and_reports_damage():
    whole = [warc.record(i, "u", b"p" * i * 500_000, "d", None) for i in range(4)]
    one = gzip.compress(b"".join(whole))
    several = gzip.compress(whole[0] + whole[1]) + gzip.compress(b"") + gzip.compress(whole[2] + whole[3])
    for raw in (one, several):
        assert [w for _, _, w in warc.records(io.BytesIO(raw))] == whole
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(one[:-40])))
    assert list(warc.records(io.BytesIO(b""))) == []
