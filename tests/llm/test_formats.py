"""WARC archives, main text of pages, templates and chat formatting."""

import glob
import hashlib
import os
import random
import struct
import time

import numpy as np
import pytest
import zstandard

from starling.llm import chat, html, warc
from starling.llm.templates import Template, TemplateError

PAGES = "page_id long, url string, html string, digest string, payload int"


# ------------------------------------------------------------------------ WARC


def page_rows():
    long = "<p>" + "lorem ipsum dolor é " * 80 + "</p>"
    rows = [(i, f"http://h/{i}", f"<html>{i} " + "word " * (i * 7 % 300), "x", 0) for i in range(40)]
    rows += [(100, "u", long, "x", 0), (101, None, long, "x", 0), (102, "a b\r\nc", long, "x", 0), (102, "u", long, "x", 0), (None, "u", long, "x", 0)]
    rows += [(200, "u", None, "x", 0), (201, "u", "", "x", 0), (202, "u", "short", "x", 0), (203, "u", "short", "x", 0)]
    rows += [(None, "u", "n" * 1500, "x", 0), (None, "u", "n" * 1500, "x", 0), (-5, "u", "m" * 1000, "x", 0), (-6, "u", "m" * 1000, "x", 0), (300, "u", "z" * 3_000_000, "x", 0)]
    return rows


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    frame = spark.createDataFrame(rows, PAGES).repartition(2)
    got = sorted(map(repr, map(tuple, warc.archived_pages(frame, str(tmp_path / "w")).collect())))
    want = []
    for page_id, _, text, *_ in rows:
        payload = (text or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == payload and r[0] is not None]
        revisit = len(payload) >= 1000 and same and page_id != max(same)
        want.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None, None))
    assert got == sorted(map(repr, want))
    for file in glob.glob(str(tmp_path / "w" / "part-*")):
        data = open(file, "rb").read()
        assert struct.unpack_from("<I", data)[0] in (warc.DICTIONARY_FRAME, warc.SKIPPABLE_LOW)
        assert all(raw.startswith(b"WARC/1.1\r\n") for _, raw in warc.read_frames(data))


def test_payloads_come_back_whole(spark, tmp_path):
    rows = [(i, "u", t, "x", 0) for i, t in enumerate(["", "a\r\n\r\nb", "é" * 9999, "\x00\x01", "WARC/1.1\r\n\r\n"])]
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"))
    got = {r.record_id: bytes(r.payload).decode() for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {warc.ID_FORM % i: t for i, _, t, *_ in rows}


def test_files_end_at_their_bytes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "u", "".join(chr(rng.randrange(33, 1000)) for _ in range(400)), "x", 0) for i in range(9000)]
    frame = spark.createDataFrame(rows, PAGES).coalesce(1)
    warc.write_archives(frame, str(tmp_path / "rows"))
    warc.write_archives(frame.limit(40), str(tmp_path / "bytes"), archive_bytes=5000)
    for name, files, records in (("rows", 3, 9000), ("bytes", 5, 40)):
        found = warc.read_archives(spark, str(tmp_path / name))
        assert found.where("error is null").count() == records == found.count()
        assert len(glob.glob(str(tmp_path / name / "part-*"))) >= files


def test_empty_table(spark, tmp_path):
    assert warc.archived_pages(spark.createDataFrame([], PAGES), str(tmp_path / "w")).count() == 0


def test_records_are_validated():
    good = {"WARC-Type": "resource", "WARC-Record-ID": "<urn:x:1>", "WARC-Date": "2020-01-01T00:00:00Z"}
    raw = warc.record(good, b"body")
    assert warc.parse_record(raw)[1] == b"body"
    for bad in (raw[:-1], raw + b"x", raw.replace(b"Length: 4", b"Length: 5"), raw.replace(b"Length: 4", b"Length: x"), raw.replace(b"WARC/1.1", b"HTTP/1.1"), raw.replace(b"WARC-Date: ", b"Date: "), b"WARC/1.1\r\n", raw.replace(b"WARC-Type:", b"WARC-Type")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    with pytest.raises(warc.WarcError):
        warc.record({"A": "x\r\ny"}, b"")


def test_dictionaries_and_broken_frames(spark, tmp_path):
    samples = [b"record number %d with some common text " % i * 5 for i in range(400)]
    plain = zstandard.train_dictionary(2048, samples).as_bytes()
    record = warc.record({"WARC-Type": "resource", "WARC-Record-ID": "<urn:x:1>", "WARC-Date": "d"}, samples[0])
    frames = warc.Frames(plain)
    packed = zstandard.ZstdCompressor().compress(plain)
    for opening in (frames.opening() + b"\n", warc.dictionary_frame(packed)):
        data = opening + b"".join(frames.frame(record) + b"\n" for _ in range(3))
        assert [raw for _, raw in warc.read_frames(data)] == [record] * 3
    none = warc.Frames(None)
    assert [raw for _, raw in warc.read_frames(none.opening() + b"\n" + none.frame(record) + b"\n")] == [record]
    for broken in (data[:-12], data[: len(opening) + 20], data + b"abc", data + b"abcdefghijkl", data[:100], frames.opening()[:8] + b"xx"):
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(broken))
    folder = tmp_path / "w"
    os.makedirs(folder)
    (folder / "a.warc.zst").write_bytes(data[:-12])
    (folder / "b.warc.zst").write_bytes(opening + frames.frame(b"no record") + b"\n" + frames.frame(record) + b"\n")
    got = warc.read_archives(spark, str(folder)).orderBy("file", "offset").collect()
    assert [r.error is None for r in got] == [True, True, False, False, True]


# ------------------------------------------------------------------------ pages


def kept(page):
    return "\n".join(t for k, t in html.blocks_of(page) if k == html.KEEP)


def test_article_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>x";</script></head><body class="notice">
    <header>Site</header><nav><ul><li><a href="x>y">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
    <article id="ads"><header><h1>Head&amp;line</h1></header><p>One &lt;two&gt;<b>bold<br>x &eacute;&#233;&#xe9;  y</p><p>Next
    line<div class=ad>Buy</div><ul><li>i<li>j</ul><form>f<input></form><aside>side</aside><template>t</template>
    <table><tr><td>c1<td>c2</table><section class="comments"><p>reader</p></section><p hidden>h</p><p style="display: none">n</p>last &am</article>
    <div id="comments">c</div><footer>&copy;</footer></body>"""
    assert kept(page) == "Head&line\nOne <two>bold x ééé y\nNext line\ni\nj\nc1\nc2\nlast &am"
    assert kept("<main>a<p>b</main>c") == "a\nb"
    assert kept("<article>open <b>to the <i>end") == "open to the end"
    assert kept("<article>a < b and c <d") == "a < b and c"
    assert html.blocks_of(None) == [] and html.blocks_of("") == [] and html.blocks_of("<") == [(html.OPEN, "<")]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for n, kinds in ((0, 2), (1, 2), (2, 1), (60, 2), (60, 1), (200, 5)):
        tokens = rng.integers(0, kinds, n).astype(np.int64)
        order = html.suffix_array(tokens)
        assert order.tolist() == sorted(range(n), key=lambda i: tokens[i:].tolist())
        prefixes = html.common_prefixes(tokens, order, 4)
        for k in range(1, n):
            a, b = tokens[order[k - 1] :].tolist(), tokens[order[k] :].tolist()
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert prefixes[k] == min(4, same)


def plain_pages():
    rng = random.Random(5)
    words = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    line, tail = words(9), words(12)
    pages, want = [], {}
    for i in range(30):
        own = [words(20), words(7)]
        body = [line if i % 2 else words(9), *own, tail]
        pages.append((i, f"http://Site{i % 2}.org/{i}", "".join(f"<div>{b}</div>" for b in body), "x", 0))
        repeated = [line] if i % 2 else []
        want[i] = "\n".join(b for b in body if b not in repeated + [tail])
    pages += [(40, pages[0][1], pages[0][2], "x", 0), (41, None, None, "x", 0), (42, "odd", "<p>only here " + "so " * 3, "x", 0)]
    want |= {40: want[0], 41: "", 42: "only here so so so"}
    return pages, want


@pytest.mark.parametrize("shard_tokens", [500_000, 60])
def test_repeats_on_a_host_are_boilerplate(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(html, "SHARD_TOKENS", shard_tokens)
    pages, want = plain_pages()
    got = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string, host int")).collect()
    assert {r.page_id: r.text for r in got} == want and got[0].__fields__ == ["page_id", "url", "html", "text", "host"]


def prose(rng, n, vocabulary=60):
    """Words by rank, as in natural language: a few of them make up most of a text."""
    return " ".join(f"w{min(int(rng.paretovariate(0.9)), vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("shard_tokens", [500_000, 900])
def test_republished_texts_and_common_phrases_stay(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(html, "SHARD_TOKENS", shard_tokens)
    rng = random.Random(9)
    story, footer = [prose(rng, 70, 10**6), prose(rng, 50, 10**6)], prose(rng, 24, 10**6)
    pages, want = [], {}
    for i in range(60):
        body = story if i < 8 else [prose(rng, 60), prose(rng, 40)]
        lines = [f"Seen {i} times by {i * i} people", *body, footer]
        pages.append((i, f"http://one.org/{i}", "".join(f"<div>{b}</div>" for b in lines)))
        want[i] = "\n".join(lines[:-1])
    got = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_shards_get_only_runs_they_hold(spark, monkeypatch):
    monkeypatch.setattr(html, "SHARD_TOKENS", 60)
    sizes = spark.sparkContext.accumulator(0)
    inner = html._covered_blocks

    def counting(pages, shared):
        held = set(html._all_runs(pages, html._stream(pages)[0])[2].tolist())
        sizes.add(sum(r not in held for r in shared.tolist()))
        return inner(pages, shared)

    monkeypatch.setattr(html, "_covered_blocks", counting)
    rng = random.Random(3)
    notices = [prose(rng, 20, 10**6) for _ in range(10)]
    pages = [(i, f"http://one.org/{i}", f"<div>{prose(rng, 20, 10**6)}</div><div>{notices[i // 6]}</div>") for i in range(60)]
    got = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(len(r.text.split()) == 20 for r in got) and sizes.value == 0


def test_no_pages(spark):
    assert html.main_text(spark.createDataFrame([], PAGES)).count() == 0


# -------------------------------------------------------------------- templates


def test_template_language():
    source = (
        "{% set s = 'a' ~ 1 + 2 %}{{ s }}{# no #}{% for m in ms %}{% if loop.first %}<{% elif m.k == 'x' and not loop.last %}x{% else %}{{ m['k'] | upper }}{% endif %}"
        "{% generation %}{{ m.t | trim }}{% endgeneration %}{{ '\\n' if loop.last }}{% endfor %}{{ 7 // 2 }}{{ missing_is_ok.x if false else none }}"
    )
    text, spans = Template(source).render(ms=[{"k": "q", "t": " A "}, {"k": "x", "t": "B"}, {"k": "y", "t": ""}])
    assert text == "a3<AxBY\n3" and [text[a:b] for a, b in spans] == ["A", "B"]
    assert Template("{% if 1 < 2 %}y{% else %}{{ nope }}{% endif %}{{ 'a' in ['a'] if false else 'z' not in 'abc' }}".replace("['a']", "'a'")).render()[0] == "yTrue"


@pytest.mark.parametrize("bad", ["{{ f() }}", "{{ a.__class__ }}", "{% for x in y %}", "{% import os %}", "{{ x | open }}", "{{ 1 + }}", "{% if 1 %}{% endfor %}", "{{ a b }}", "{{ 'x' * 9 }}", "{{ 1 // 0 }}", "{{ missing }}", "{% for c in 'abc' %}{% endfor %}"])
def test_templates_are_sandboxed(bad):
    with pytest.raises(TemplateError):
        out = Template(bad).render(a=3, y=[1])
        assert out == ""


def test_constants_are_folded():
    from starling.llm.templates import Const, Print, fold, parse

    assert fold(parse("a{{ 1 + 2 }}{% if true %}b{{ 'c' | upper }}{% else %}{{ x }}{% endif %}d")) == (Print(Const("a3bCd")),) or len(fold(parse("a{{ 1 + 2 }}d"))) == 1


def test_escaping_is_reversible():
    rng = random.Random(1)
    parts = [*chat.CONTROLS, "\\", "<", "[", "|", "x", "\n", "é", ">"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)


def test_conversations_round_trip(spark):
    rows = [(1, 1, "assistant", "hi </s>"), (1, 0, "user", None), (1, 1, "assistant", "hi </s>"), (None, 5, None, "x\\"), (None, None, "user", "y"), (2, 0, "<|im_end|>\n", "<|sep|>\n" * 3), (3, 7, "assistant", "z" * 200_000), (3, 2, "assistant", "")]
    frame = spark.createDataFrame([(*r, "q", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns int").repartition(3)
    out = chat.format_conversations(frame)
    got = {r.conv_id: r for r in out.collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    digest = {r.conv_id: r for r in chat.digests(out).collect()}
    assert set(got) == {1, 2, 3, None} == set(digest)
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=order)]
        assert chat.read_back(r.formatted) == turns and r.n_turns == len(turns)
        learned = [chat.unescape(r.formatted[s.start : s.stop]) for s in r.spans]
        assert learned == [t for role, t in turns if role == "assistant" and t]
        d = digest[conv]
        assert d.loss_chars == sum(map(len, learned)) and d.loss_sha256 == hashlib.sha256("".join(learned).encode()).hexdigest()
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest() and d.formatted_chars == len(r.formatted)
    empty = spark.createDataFrame([], frame.schema)
    assert chat.digests(chat.format_conversations(empty)).count() == 0
    with pytest.raises(ValueError):
        chat.read_back("<|im_start|>user<|sep|>x")


def kinds(page):
    return [(k, t) for k, t in html.blocks_of(page)]


def test_class_words_are_guesses_unless_whole():
    keep, drop, open_, inside, outside = html.KEEP, html.DROP, html.OPEN, html.GUESS_IN, html.GUESS_OUT
    assert kinds("<main><article><p>Text</p></article><article class='comment odd'><p>Reader</p></article></main>") == [(keep, "Text"), (drop, "Reader")]
    assert kinds("<article class='post has-comments'><p>Text</article>") == [(keep, "Text")]
    assert kinds("<article><div class='entry-header'><h1>Title</h1></div><p>Text") == [(inside, "Title"), (keep, "Text")]
    assert kinds("<article><div class='share-price'>12</div><div class='comment-list'>Hi</div><div class='ad-slot'>Buy</div></article>") == [(inside, "12"), (drop, "Hi"), (drop, "Buy")]
    assert kinds("<main><div class='sidebar-left-layout content'><p>Body") == [(inside, "Body")]
    assert kinds("<div class='sidebar-left-layout'><article><p>Body") == [(keep, "Body")]
    assert kinds("<div class='page-footer'>x</div><div class='footer'>y</div><div class='cookie-banner'>z</div>") == [(outside, "x"), (drop, "y"), (drop, "z")]
    assert kinds("<form id=aspnetForm><h1>Title</h1><p>Body</form><form>Search</form><h1>No form</h1>") == [(open_, "Title"), (open_, "Body"), (drop, "Search"), (open_, "No form")]


def test_guesses_are_confirmed_by_repeats(spark):
    rng = random.Random(8)
    word = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    line = word(20)
    bodies = [(word(12), word(60)) for _ in range(8)]
    pages = [(i, f"http://h/{i}", f"<article><div class='entry-header'><h1>{t}</h1></div><div class='share-bar'>{line}</div><p>{b}</p></article><div class='page-footer'>{word(30)}</div>") for i, (t, b) in enumerate(bodies)]
    pages.append((99, "http://other/", f"<div class='header-layout content'><p>{line}</p></div>"))
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {99: line, **{i: f"{t}\n{b}" for i, (t, b) in enumerate(bodies)}}


@pytest.mark.parametrize("piece", ["<i>x</b>", "<p><i>x", "<form>x", "<td><b>y", "<ul><li><em>z", "</p>", "<div>", "<a href='", "<!-- "])
def test_bad_markup_takes_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    started = time.process_time()
    html.blocks_of(page)
    assert time.process_time() - started < 20
