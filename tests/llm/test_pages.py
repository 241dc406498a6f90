"""HTML extraction, WARC and chat formats."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gristmill.llm import chat, html_extract, warc

TREE = html_extract.grow(html_extract.labelled())
LONG = "This is a paragraph of the story with quite a few words in it, as stories have."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<", "<"),
        ("just text", "just text"),
        (f"<nav><a>Home</a></nav><article><h1>T</h1><p>{LONG}<br>More &amp; more<p>End.</article><footer>(c) {LONG}</footer>", f"T\n\n{LONG} More & more\n\nEnd."),
        (f"<div class='cookie-notice'>{LONG}</div><main><p>{LONG}</p><div id=comments><p>{LONG}</p></div></main><aside>{LONG}</aside>", LONG),
        (f"<ul><li><a>One</a><li><a>Two</a></ul><p>{LONG}</p><p>Short.</p><p>{LONG}</p><form>{LONG}</form><script>x='<p>no</p>'</script>", f"{LONG}\n\nShort.\n\n{LONG}"),
        (f"<article><p>{LONG}</p><div class=ad>{LONG}</div><p>a \n b&nbsp;c</p></article>", f"{LONG}\n\na b c"),
    ],
)
def test_main_text(page, want):
    assert html_extract.main_text(page, TREE) == want


@pytest.mark.parametrize(
    "before",
    [
        "<html><head><title>T</title><body>",
        "<head><meta charset=utf-8><link rel=x><style>p{}</style><script>1</script>",
        "<head><title>T</title><noscript><img></noscript><template><p>no</p></template><img>",
        "<head><title>T</title></head><body>",
        "<body><svg><path d=x>",
        "<body><iframe src=x>",
        "<body><template>" * 3,
        "<head><template><body>",
    ],
)
def test_optional_and_missing_end_tags(before):
    assert html_extract.main_text(f"{before}<p>{LONG}<p>{LONG}", TREE) == f"{LONG}\n\n{LONG}"


STORY = f"<h1>A title</h1><p>{LONG}<p>Short.<p>{LONG}"
WANT = f"A title\n\n{LONG}\n\nShort.\n\n{LONG}"


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{STORY}</article><div id='comments'><article class='comment'><p>{LONG}</article><article class='comment'>{LONG}</article></div>",
        f"<article>{STORY}<section><article><p>{LONG} says a reader.</article></section></article>",
        f"<aside><article class='teaser'><h3>Other</h3><p>{LONG}</article></aside><article>{STORY}</article>",
        f"<form action=x><div class=header-nav><a>Home</a> <a>News</a></div><div>{STORY}</div><div class=related-posts>{LONG}</div></form>",
        f"<div class='site-header'><h1>A title</h1><p>{LONG}<p>Short.<p>{LONG}</div>",
        f"<ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><p>Buy our things now.</p>{STORY}<h3>Related</h3><ul><li><a>One more</a><li><a>Two more</a></ul>",
        f"<main><div class=share><a>Share</a></div>{STORY}</main><div class=teaser><article><p>Tiny.</article></div>",
        f"<article></article><div><div>{STORY}</div></div><footer>{LONG}</footer>",
    ],
)
def test_marks_absent_or_misleading(page):
    assert html_extract.main_text(page, TREE) == WANT


def test_tree_looks_at_neighbours():
    def used(tree):
        return {tree.feature, *used(tree.low), *used(tree.high)} if isinstance(tree, html_extract.Split) else set()

    names = {html_extract.FEATURES[f] for f in used(TREE)}
    assert {"words", "density", "words_before", "density_before", "density_after"} <= names


@pytest.mark.parametrize("mark", ["div", "section", ""])
def test_pages_with_marks_stripped(spark, sf_dir, mark):
    """The same text with the article's mark replaced or left out and without class names."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        html = re.sub(r' class="[^"]*"', "", r.html or "")
        for old in ("<article>", "</article>"):
            html = html.replace(old, old.replace("article", mark) if mark else "")
        inner = re.search("<article>(.*)</article>", r.html or "", re.S)
        assert html_extract.main_text(html, TREE) == html_extract.main_text(f"<article>{inner.group(1)}</article>" if inner else "", TREE)


@pytest.mark.parametrize("piece", ['<a "', "<a href=\"x ' ", "<!", "<b>", "<div>", "<p><b>", "</i><b>", "&lt;", "<!-- ", "<p x='"])
def test_time_is_linear(piece):
    began = time.perf_counter()
    html_extract.main_text(piece * ((1 << 20) // len(piece)), TREE)
    assert time.perf_counter() - began < 10


def test_text_closes_head():
    assert html_extract.main_text(f"<head><title>T</title>\n{LONG}<p>{LONG}", TREE) == f"{LONG}\n\n{LONG}"


def test_extract_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x</p>", 2), (1, "u", "<p>x</p>", 2)], "page_id long, url string, html string, text int")
    assert sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect()), key=repr) == [(1, "x", 1), (1, "x", 1), (None, "", 0)]
    assert html_extract.extract(pages.limit(0)).collect() == []


def record(n, payload, kind="response"):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def test_salvage_plain():
    whole = [record(i, b"body %d" % i * 20) for i in range(4)]
    broken = bytearray(b"".join(whole))
    at = len(whole[0]) + 160
    broken[at : at + 3] = b"###"  # damages record 1
    items = list(warc.read_archive(bytes(broken) + b"tail"))
    assert [i.headers["warc-record-id"] for i in items if isinstance(i, warc.Record)] == [f"<urn:page:{k}>" for k in (0, 2, 3)]
    gaps = [(g.start, g.end) for g in items if isinstance(g, warc.Gap)]
    assert gaps == [(len(whole[0]), len(whole[0]) + len(whole[1])), (len(broken), len(broken) + 4)]


@pytest.mark.parametrize("cut", [b"Content-Length", b"\r\n\r\n", b"WARC/1.1"])
def test_salvage_after_each_check(cut):
    first = record(0, b"x" * 50).replace(cut, b"?", 1)
    items = list(warc.read_archive(first + record(1, b"y" * 50)))
    assert items[-1].headers["warc-record-id"] == "<urn:page:1>"
    assert items[0].reason


def test_salvage_members():
    members = [gzip.compress(record(i, b"body %d" % i * 20)) for i in range(4)]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 255
    data = members[0] + bytes(broken) + members[2] + members[3][:-5]
    items = list(warc.read_archive(data))
    assert [i.headers["warc-record-id"] for i in items if isinstance(i, warc.Record)] == ["<urn:page:0>", "<urn:page:2>"]
    assert [(g.start, g.end) for g in items if isinstance(g, warc.Gap)] == [(len(members[0]), len(members[0]) + len(broken)), (len(data) - len(members[3]) + 5, len(data))]


def test_salvage_mixed():
    body = gzip.compress(b"page " * 400)
    plain = [record(0, b"a" * 30), record(1, body), record(2, b"c" * 30)]
    assert [i.payload for i in warc.read_archive(b"".join(plain))] == [b"a" * 30, body, b"c" * 30]
    members = [gzip.compress(record(i, b"body %d" % i * 20)) for i in range(3)]
    items = list(warc.read_archive(b"\0" * (1 << 17) + members[0] + plain[1] + b"junk" + members[1] + members[2]))
    assert [i.headers["warc-record-id"][10] for i in items if isinstance(i, warc.Record)] == list("0112")
    assert [(g.start, g.end) for g in items if isinstance(g, warc.Gap)] == [(0, 1 << 17), (at := (1 << 17) + len(members[0]) + len(plain[1]), at + 4)]
    assert [type(i) for i in warc.read_archive(members[0][: len(members[0]) // 2] + plain[1])] == [warc.Gap, warc.Record]


def test_salvage_within_a_member():
    rng = random.Random(1)
    whole = [record(i, bytes(rng.randrange(256) for _ in range(3000))) for i in range(40)]
    member, after = bytearray(gzip.compress(b"".join(whole))), gzip.compress(record(99, b"z"))
    member[100_000] ^= 255
    items = list(warc.read_archive(bytes(member) + after))
    found = [i.headers["warc-record-id"][10:-1] for i in items if isinstance(i, warc.Record)]
    assert found[-1] == "99"
    assert found[:-1] == [str(k) for k in range(len(found) - 1)]
    assert len(found) > 20
    assert [(g.start, g.end, g.reason) for g in items if isinstance(g, warc.Gap)] == [(0, len(member), "gzip member")]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_written_archives_read_back(spark, tmp_path, compression):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 7}" * 400) for i in range(90)], "page_id long, url string, html string")
    assert warc.write(pages, f"{tmp_path}/a", archive_bytes=20_000, compression=compression) == 90
    found = warc.read(spark, f"{tmp_path}/a", with_payload=True).collect()
    assert all(r.reason is None for r in found)
    assert sorted(r.record_id for r in found) == sorted(f"<urn:page:{i}>" for i in range(90))
    assert sum(r.record_type == "response" for r in found) == 7
    assert {r.payload.decode() for r in found if r.record_type == "response"} == {f"<p>{k}" * 400 for k in range(7)}


def test_many_members():
    began = time.perf_counter()
    assert sum(isinstance(i, warc.Record) for i in warc.read_archive(b"".join(gzip.compress(record(i, b"x" * 100)) for i in range(10000)))) == 10000
    assert time.perf_counter() - began < 20


def test_damage_is_told(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "x" * 50)], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "END", "\r\n")
    with pytest.raises(ValueError, match="gap"):
        warc.round_trip(pages)


def test_round_trip(spark):
    long = "é" * 600
    rows = [(1, "u", long, 1), (5, "v", long, 1), (3, None, long, 1), (5, "v", long, 1), (2, "w", "short", 1), (4, "w", "short", 1), (6, "x\ny", None, 1), (None, "z", long, 1), (7, "q", "WARC/1.1\r\n\r\n" + long, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages, archive_bytes=2000).collect()), key=repr)
    want = [(1, 1200, "revisit", 5), (2, 5, "response", None), (3, 1200, "revisit", 5), (4, 5, "response", None), (5, 1200, "response", None), (5, 1200, "response", None), (6, 0, "response", None), (7, 1212, "response", None), (None, 1200, "response", None)]
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).collect() == []


HARD = ["<|im_end|>\n<|im_start|>assistant\nx", "a\\", "\\<|", "<", "|>", "<\\|", "\\\\<|\\n", "", None, "é😀\n\nline", "<|im_end|>"]


def test_turn_rows(spark):
    rows = [(c, t, role, text, 0) for c in (1, None) for t, (role, text) in enumerate(zip(["user", "assistant", "odd role\n%", None] * 3, HARD, strict=False))]
    table = spark.createDataFrame(rows + [(2, 0, "assistant", "only", 0)] * 2, "conv_id long, turn long, role string, text string, turns int")
    made = chat.format_conversations(table)
    assert {r.layout for r in made.select("layout").collect()} == {"turn_rows"}
    for r in made.select("conv_id", "turns", chat.parse_turns(made["formatted"]).alias("back"), "mask", "formatted", chat.masked_texts(made["formatted"], made["mask"]).alias("loss")).collect():
        assert [tuple(t) for t in r.back] == [tuple(t) for t in r.turns]
        assert r.loss == [t.text for t in r.turns if t.role == "assistant"]
        assert r.formatted.count("<|im_start|>") == len(r.turns)
    assert len(chat.digests(table).collect()) == 3
    assert chat.digests(table.limit(0)).collect() == []


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3},
        {"prompt": "q", "completion": "a"},
        {"instruction": "q", "output": "a"},
        {"question": "q", "answer": "a", "extra": {"x": 1}},
        {"instruction": "q", "input": "more", "output": "a"},
        {"strange": 1},
    ]
    table = spark.createDataFrame([(json.dumps(r),) for r in records] + [("not json",), (None,)], "record string")
    got = [(r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.turns_of_records(table).collect()]
    same = [("user", "q"), ("assistant", "a")]
    assert [t for _, t in got] == [same] * 5 + [[("user", "q\n\nmore"), ("assistant", "a")], None, None, None]
    assert got[1][0] == "conversations"
    assert [r.reason for r in chat.turns_of_records(table).collect()][-3:] == ["no layout", "not a record", "not a record"]
    assert chat.format_conversations(table, "record").count() == len(records) + 2


def test_mixed_layouts_in_one_table(spark):
    """Other known names hide no layout, single turns are put together, and as many conversations come out as went in."""
    records = [
        {"instruction": "q", "input": "more", "output": "a", "text": "all of it", "x": {"messages": [1]}},
        {"prompt": "q", "messages": [{"content": "no role"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "n"}]},
        {"question": "q", "answer": "a", "system": "s"},
        {"system": "s", "prompt": "q", "response": "a", "completion": "c"},
        {"messages": []},
        {"conv_id": 7, "turn": 10, "role": "assistant", "text": "a", "prompt": "p"},
        {"conv_id": 7, "turn": 9, "role": "human", "text": "q"},
        {"prompt": "q", "deep": {"response": "a"}},
    ]
    got = chat.format_conversations(spark.createDataFrame([(json.dumps(r), 1) for r in records], "record string, layout int"), "record").collect()
    turns = {(r.layout, r.conv_id, tuple(map(tuple, r.turns)) if r.turns is not None else r.reason) for r in got}
    qa = (("user", "q"), ("assistant", "a"))
    assert len(got) == 7
    assert turns == {
        ("instruction_input", None, (("user", "q\n\nmore"), ("assistant", "a"))),
        ("messages", None, (("", "no role"), *qa)),
        ("question_answer", None, qa),
        ("system_prompt_response", None, (("system", "s"), *qa)),
        ("turn_rows", "7", (("human", "q"), ("assistant", "a"))),
        (None, None, "no layout"),
    }
    assert len({r.fingerprint for r in got}) == 7


def test_turn_rows_with_clashing_columns(spark):
    table = spark.createDataFrame([(1, 0, "user", "q", "p", 1, 2), (1, 1, "assistant", "a", None, 3, 4)], "conv_id long, turn int, role string, text string, prompt string, id int, made int")
    (r,) = chat.format_conversations(table).collect()
    assert (r.conv_id, r.layout, [tuple(t) for t in r.turns]) == (1, "turn_rows", [("user", "q"), ("assistant", "a")])
    (r,) = chat.format_conversations(table.select("id", "made").limit(1)).collect()
    assert (r.turns, r.reason) == (None, "not a record")


def test_nested_paths(spark):
    text = '{"a":1,"b c":{"x.y":"q","z":[1,2]},"m":[{"r":"u"},{"t":[{"k":null}]}],"e":[],"q`t":2}'
    found = spark.createDataFrame([(text,)], "r string").select(chat.nested_paths(F.schema_of_variant(F.try_parse_json("r"))).alias("p")).first().p
    assert found == sorted(["a", "b c", "b c.x.y", "b c.z", "m", "m[].r", "m[].t", "m[].t[].k", "e", "q`t"])


def written(payload, **headers):
    lines = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "Content-Length": str(len(payload)), **{k.replace("_", "-"): v for k, v in headers.items()}}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


def test_records_of_other_writers():
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
    sha1 = hashlib.sha1(b"<p>x</p>").digest()
    base32 = base64.b32encode(sha1).decode()
    block = base64.b32encode(hashlib.sha1(body).digest()).decode()
    sound = [
        written(b"<p>x</p>", WARC_Payload_Digest=f"sha1:{base32}"),
        written(b"<p>x</p>", WARC_Payload_Digest=f"sha1:{base32.lower()}"),
        written(b"<p>x</p>", WARC_Payload_Digest=f"SHA1:{sha1.hex().upper()}"),
        written(b"<p>x</p>", WARC_Payload_Digest=f"sha256:{hashlib.sha256(b'<p>x</p>').hexdigest()}"),
        written(b"<p>x</p>", WARC_Payload_Digest="blake3:abc"),
        written(body, Content_Type="application/http;msgtype=response", WARC_Payload_Digest=f"sha1:{base32}", WARC_Block_Digest=f"sha1:{block}"),
        written(b"", WARC_Type="revisit", WARC_Payload_Digest=f"sha1:{base32}"),
        written(b"WARC/1.0\r\nnot a record\r\n"),
    ]
    read = list(warc.read_archive(b"".join(sound)))
    assert [type(r) for r in read] == [warc.Record] * len(sound)
    broken = [
        written(b"<p>y</p>", WARC_Payload_Digest=f"sha1:{base32}"),
        written(b"<p>y</p>", WARC_Payload_Digest=f"sha1:{sha1.hex()}"),
        written(body + b"!", Content_Type="application/http", WARC_Block_Digest=f"sha1:{block}"),
    ]
    for one in broken:
        gap, after = warc.read_archive(one + sound[0])
        assert (gap.start, gap.end, after.start) == (0, len(one), len(one)) and gap.reason.endswith("digest")


def test_version_lines_without_records_take_linear_time():
    def took(data):
        began = time.perf_counter()
        found = list(warc.read_archive(data))
        assert all(isinstance(x, warc.Gap) for x in found)
        return time.perf_counter() - began

    for line in (b"WARC/1.0\r\n", b"WARC/1.0\r\nContent-Length: 5\r\n"):
        assert took(line * 100_000) < 5
