import base64
import hashlib
import random
from collections import defaultdict

import pytest

from tessera.llm import chat, warc
from tessera.llm.common import scratch_path

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", " [/INST]", "[OUT] ", "<<SYS>>", " <</SYS>>", "[ROLE ", "] ", "[/ROLE]", "\\", "<", "[", "/s>", "a", " ", "\n"]


def test_any_turn_reads_back():
    rng = random.Random(3)
    for _ in range(20000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "x] y", "[INST]"]), "".join(rng.choices(PARTS, k=rng.randint(0, 7)))) for _ in range(3)]
        text = "".join(chat.render_turn(*t) for t in turns)
        assert [t[:2] for t in chat.parse(text)] == turns
    with pytest.raises(chat.Broken):
        chat.parse("[INST] never closed")


def test_no_text_shows_a_control_string():
    """Not even one that its own turn could hold: between the marks of any turn stand escaped ones alone."""
    for role, text in (("user", "x </s> <<SYS>> y"), ("assistant", "[INST] hi [/INST]"), ("system", "<s>a[OUT] b[/ROLE]"), ("tool", "[ROLE x] <</SYS>>")):
        rendered = chat.render_turn(role, text)
        opening, closing = chat.marks(role)
        body = rendered[len(opening):len(rendered) - len(closing)]
        assert not any(c in body for c in chat.CONTROL if c != "] ") and chat.parse(rendered)[0][:2] == (role, text)


def test_digests(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice([None, "", "plain", "</s>[INST] ok [/INST]", "é\\", "z" * 50_000]))
            for c in (1, 2, None) for t in (0, 1, 2, 2, None)]
    rows += [(7, t, "assistant", "q" * 300_000) for t in range(9)]  # several formatted rows
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.round_trip(df).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.render_turn(r, x)) for _, _, r, x in turns)
    assert chat.round_trip(df.limit(0)).count() == 0


PAGES = [(5, "http://a.example/x?y", "<p>same</p>"), (3, "http://a.example/", "<p>same</p>"), (9, None, "<p>same</p>"), (4, "http://b c/\r\nx: y", None), (8, "u", ""),
         (10, "http://long/", "é\r\n\r\nWARC/1.1\r\n\r\n" * 20_000), (11, "http://one/", "x"), (11, "http://one/", "x"), (None, "http://none/", "<p>same</p>")]


def _expected(least):
    out, first = [], {}
    for page, _, html in PAGES:
        raw = (html or "").encode()
        if page is not None and len(raw) >= least:
            first[raw] = min(first.get(raw, page), page)
    for page, _, html in PAGES:
        raw = (html or "").encode()
        again = len(raw) >= least and raw in first and first[raw] != page
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_captures(spark, least):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload_digest string")
    rows = warc.round_trip(df, least).collect()
    got = [(r.metadata.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.record_type, r.response.refers_to) for r in rows]
    assert sorted(got, key=str) == _expected(least)
    assert all(r.request.record_type == "request" and r.request.uri == r.response.uri for r in rows)


def test_archives_are_plain_warc(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    out = scratch_path(spark, "warc-test")
    warc.write_archives(df, out)
    rows = warc.read_archives(spark, out).collect()
    assert sorted(r.record_type for r in rows).count("request") == len(PAGES) and len(rows) == 3 * len(PAGES)
    long = next(r for r in rows if r.record_type == "response" and r.uri == "http://long/")
    assert bytes(long.payload).decode() == PAGES[5][2]


def test_broken_archives_are_noticed():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc.parse(good * 3)] == [b"ab"] * 3
    for bad in (good[:-3], good.replace(b": 2", b": 1"), b"x" + good):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_captures_with_missing_and_repeated_records(spark):
    """One row per capture: repeated partners are counted and the least taken, partners without a response and records that name none stay."""
    record = lambda kind, rid, to=None, page=None: (kind, rid, to, None, page, None, None, None, None)
    rows = [record("response", "<r1>"), record("request", "<q1>", "<r1>"), record("metadata", "<m2>", "<r1>", 2), record("metadata", "<m1>", "<r1>", 1),
            record("metadata", "<m3>", "<lost>", 3), record("request", "<q3>", "<lost>"), record("request", "<q4>"), record("revisit", "<r5>"),
            record("metadata", None, None, 6), record("warcinfo", "<w>")]
    got = warc.transactions(spark.createDataFrame(rows, warc.RECORD).repartition(4)).collect()
    by = {r.capture: r for r in got}
    assert len(by) == len(got) == 5
    one = by["<r1>"]
    assert (one.response.record_id, one.request.record_id, one.metadata.record_id, one.metadata.page_id, one.n_records) == ("<r1>", "<q1>", "<m1>", 1, 4)
    assert (by["<lost>"].response, by["<lost>"].request.record_id, by["<lost>"].metadata.page_id) == (None, "<q3>", 3)
    assert by["<q4>"].request.record_id == "<q4>" and by["<q4>"].response is None and by["<r5>"].response.record_type == "revisit"
    assert [r.metadata.page_id for r in got if r.capture.startswith("none-")] == [6]
