"""WebP round trips, media columns and page texts."""

import hashlib
import os
import random
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from meshframe.llm import html_text as H
from meshframe.llm import media, webp


def test_distances_come_in_the_formats_order():
    near = webp._NEAR
    assert len(near) == 120 and near[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert near[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)]


@pytest.mark.parametrize("height,width", [(1, 1), (3, 5), (24, 24), (40, 33)])
@pytest.mark.parametrize("colours", [1, 2, 4, 16, 256])
def test_webp_round_trips(height, width, colours):
    rng = np.random.default_rng(height * 1000 + colours)
    image = webp._join(rng.integers(0, colours, (height, width, 4), dtype=np.uint8))
    image[height // 2 :] = image[: height - height // 2]
    tiles = (webp._div_up(height, 4), webp._div_up(width, 4))
    for transforms in ((), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 0)):
        if 3 in transforms and len(np.unique(image)) > 256:
            continue
        for refs in (False, True):
            for cache in (0, 7):
                data = webp.encode(image, transforms, refs, cache, modes=rng.integers(0, 14, tiles), cross=rng.integers(0, 1 << 24, tiles))
                assert (webp.decode(data) == image).all()


def test_slow_and_fast_readers_agree(monkeypatch):
    rng = np.random.default_rng(2)
    image = (rng.integers(0, 90, (60, 24)).astype(np.uint32) << 8) | np.uint32(0xFF000000)
    image[30:] = image[:30]
    monkeypatch.setattr(webp, "BLOCK_BITS", 256)
    for refs in (False, True):
        data = webp.encode(image, refs=refs)
        assert (webp.decode(data) == image).all()
        with monkeypatch.context() as m:
            m.setattr(webp, "_read_fast", lambda bits, group, w, h: webp._read_slow(bits, [group], None, 0, 0, w, h))
            assert (webp.decode(data) == image).all()
    with pytest.raises(ValueError):
        webp.decode(b"RIFF0000WEBPVP8 " + bytes(20))


@pytest.mark.parametrize("raw", [b"", b"a", b"ab" * 5000, bytes(range(256)) * 30, b"x" * 500_000, bytes(1000)])
def test_payloads(raw):
    payload = media.padded(raw)
    assert len(payload) % 576 == 0 and payload.startswith(raw) and len(payload) - len(raw) in range(577)
    assert media.load(media.store(payload)) == payload


def test_op3(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = media.op3_media(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] > 0 and r["feature"].startswith("mean=")


def plain_image(body):
    """A lossless WebP read by the book, pixel by pixel and bit by bit: one group of codes, palette or predictor 1 or 2.

    Shares nothing with the module, so that a fault in both its writer and its reader shows.
    """
    assert body[:4] == b"RIFF" and body[8:16] == b"WEBPVP8L" and body[20] == 0x2F
    stream, at = int.from_bytes(body[21:], "little"), 0

    def take(n):
        nonlocal at
        at += n
        return stream >> at - n & ((1 << n) - 1)

    def symbol_of(lengths):
        """Walks a canonical code bit by bit."""
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if len(used) == 1:
            return lambda: used[0][1]
        codes, code, before = {}, 0, 0
        for n, s in used:
            code <<= n - before
            codes[n, code] = s
            code, before = code + 1, n

        def read():
            n = c = 0
            while (n, c) not in codes:
                n, c = n + 1, c << 1 | take(1)
            return codes[n, c]

        return read

    def prefix_code(size):
        lengths = [0] * size
        if take(1):
            two, first = take(1), take(8 if take(1) else 1)
            lengths[first] = 1
            if two:
                lengths[take(8)] = 1
            return symbol_of(lengths)
        own = [0] * 19
        for k in [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15][: take(4) + 4]:
            own[k] = take(3)
        read, most = symbol_of(own), size
        if take(1):
            most = 2 + take(2 + 2 * take(3))
        i, last = 0, 8
        while i < size and most:
            most -= 1
            s = read()
            if s < 16:
                lengths[i], i, last = s, i + 1, s or last
            else:
                value, times = (last, 3 + take(2)) if s == 16 else (0, 3 + take(3)) if s == 17 else (0, 11 + take(7))
                for _ in range(times):
                    lengths[i], i = value, i + 1
        return symbol_of(lengths)

    def number(s):
        return s + 1 if s < 4 else ((2 + (s & 1)) << (s - 2 >> 1)) + take(s - 2 >> 1) + 1

    def image(width, height, main):
        assert not take(1)
        assert not main or not take(1)
        green, red, blue, alpha, far = (prefix_code(n) for n in (280, 256, 256, 256, 40))
        out = []
        while len(out) < width * height:
            s = green()
            if s < 256:
                r, b, a = red(), blue(), alpha()
                out.append([a, r, s, b])
            else:
                length = number(s - 256)
                d = number(far())
                back = d - 120
                if d <= 120:
                    x, y = {1: (0, 1), 2: (1, 0), 3: (1, 1), 4: (-1, 1), 5: (0, 2), 6: (2, 0), 7: (1, 2), 8: (-1, 2)}.get(d) or webp._NEAR[d - 1]
                    back = max(1, x + y * width)
                for _ in range(length):
                    out.append(out[-back])
        return out

    width, height = take(14) + 1, take(14) + 1
    take(4)
    steps, here = [], width
    while take(1):
        kind = take(2)
        if kind == 0:
            bits = take(3) + 2
            tiles = -(-here // (1 << bits))
            steps.append(("predict", image(tiles, -(-height // (1 << bits)), False)[0][2] & 15))
        else:
            assert kind == 3
            n = take(8) + 1
            colours = image(n, 1, False)
            for i in range(1, n):
                colours[i] = [(a + b) & 255 for a, b in zip(colours[i], colours[i - 1], strict=True)]
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append(("palette", colours, bits, here))
            here = -(-here // (1 << bits))
    out = image(here, height, True)
    for step in reversed(steps):
        if step[0] == "predict":
            for i in range(len(out)):
                y, x = divmod(i, width)
                above = x == 0 or step[1] == 2
                base = [255, 0, 0, 0] if i == 0 else out[i - width] if y and above else out[i - 1]
                out[i] = [(a + b) & 255 for a, b in zip(out[i], base, strict=True)]
        else:
            _, colours, bits, wide = step
            each = 8 >> bits
            out = [colours[out[y * here + (x >> bits)][2] >> each * (x & (1 << bits) - 1) & (1 << each) - 1] for y in range(height) for x in range(wide)]
    return bytes(p[2] for p in out if p[0])


@pytest.mark.parametrize("raw", [b"", b"word " * 300, bytes(range(256)) * 9, bytes(i * 7 & 255 for i in range(5000)), b"The same line stands here twice, and it is long enough.\n" * 2 + bytes(i * i & 255 for i in range(999)), b"ab" * 600])
def test_stored_forms_by_the_book(raw):
    payload = media.padded(raw)
    assert plain_image(media.store(payload)) == payload


def test_every_part_is_chosen_where_it_pays():
    line = np.random.default_rng(8).integers(0, 90, 3000).astype(np.uint8).tobytes()
    kinds = {}
    for name, raw in (("plain", line), ("palette", b"abc" * 500), ("left", bytes(i * 7 & 255 for i in range(5000))), ("above", b"".join(bytes((c + r) & 255 for c in line[:24]) for r in range(300))), ("refs", line + line[500:2500])):
        payload = media.padded(raw)
        kinds[name] = media._transforms(payload, len(media.to_image(payload))), len(webp.repeats(np.frombuffer(payload, np.uint8))) > 1, len(media.store(payload))
        assert media.load(media.store(payload)) == payload
    assert [kinds[k][0] for k in ("plain", "palette", "left", "above")] == [((), 0), ((webp.PALETTE,), 0), ((webp.PREDICTOR,), 1), ((webp.PREDICTOR,), 2)]
    assert kinds["refs"][1] and kinds["refs"][2] < kinds["plain"][2] * 1.2


def test_repeats():
    rng = np.random.default_rng(5)
    for n, values in ((10, 3), (64, 1), (5000, 2), (20_000, 90), (9000, 1)):
        s = rng.integers(0, values, n).astype(np.uint8)
        if n > 1000:
            s[n // 2 : n // 2 + 400] = s[100:500]
        jumps, end = webp.repeats(s), 0
        for place, length, far in jumps:
            assert end <= place and far <= place and 1 <= length <= webp.LONGEST
            assert (s[place : place + length] == s[place - far : place - far + length]).all() if far >= length else len(set(s[place - far : place + length].tolist())) <= far
            end = place + length
        assert sum(length for _, length, _ in jumps) >= (300 if n > 1000 else 0)


def test_odd_texts(spark, monkeypatch):
    """Nulls, texts of several images, repeated rows, and columns with clashing names."""
    rows = [(1, None, "a"), (2, "", None), (3, "lorem ipsum " * 1000, "c"), (3, "lorem ipsum " * 1000, "c"), (None, "x", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    stored = {(r["doc_id"], bytes(r["media"])) for r in media.to_media(frame).collect()}
    assert len(stored) == 4 and len({m for i, m in stored if i in (1, 2)}) == 1
    for i, m in stored:
        text = next(t for j, t, _ in rows if i == j) or ""
        assert media.load(m) == media.padded(text.encode())
    with monkeypatch.context() as m:
        m.setattr(media, "MOST_BYTES", 576 * 4)
        payload = media.padded(b"lorem ipsum " * 1000)
        assert media.load(media.store(payload)) == payload and len(list(media.images(media.store(payload)))) == -(-len(payload) // (576 * 4))
    out = frame.select("doc_id", "text").mapInArrow(media._media, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").collect()
    assert len(out) == 5 and out[2] == out[3] and out[0][1:] == out[1][1:]


def test_media_columns_of_nulls(spark):
    stored = media.to_media(spark.createDataFrame([(1, "hello"), (2, None)], "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in media.to_pixels(stored).collect()}
    assert rows[1]["height"] == rows[1]["width"] == 24 and len(rows[2]["argb"]) == 576
    assert media.to_pixels(stored.limit(0)).count() == 0


def test_blocks_of_broken_pages():
    texts = lambda page: [b.text for b in H.blocks(page)]
    assert texts("<p>a <b>b<br>c</p><p>d&amp;&eacute;&#8212;  e") == ["a b c", "d&é— e"]
    assert texts('<script>var x="<p>no</p>";</script><style>p{}</style>yes<!-- no --><!-- open') == ["yes"]
    assert texts("<ul><li>a<li>b</ul></div></p>c<td") == ["a", "b", "c"]
    assert texts("") == texts("<p></p>") == []
    assert texts("1 < 2 and <3") == ["1 < 2 and <3"]


def test_the_field_learns():
    rng = random.Random(99)
    right = total = 0
    for _ in range(200):
        page = H.labelled_page(rng)
        tags = H.trained().article([b for b, _ in page])
        right += sum(a == b for a, (_, b) in zip(tags, page, strict=True))
        total += len(page)
    assert right / total > 0.98


def test_viterbi_is_the_best_of_all_sequences():
    from itertools import product

    rng = np.random.default_rng(1)
    field = H.Field(rng.normal(0, 1, 1 << H.HASH_BITS), rng.normal(0, 1, (2, 2)))
    page = [b for b, _ in H.labelled_page(random.Random(4))][:8]

    def value(states):
        total = sum(field.weights[H.block_features(b, i, len(page))].sum() for i, b in enumerate(page) if states[i])
        return total + sum(field.trans[a, b] for a, b in zip(states, states[1:], strict=False))

    assert field.article(page) == [bool(s) for s in max(product((0, 1), repeat=len(page)), key=value)]


class Articles(HTMLParser):
    """What stands in <article>, by the standard library's parser: a truth that shares no code with the module."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.hidden, self.parts = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.hidden += tag in ("script", "style")
        if tag not in ("b", "i", "em", "strong", "a", "span", "img"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.hidden -= tag in ("script", "style")
        if tag not in ("b", "i", "em", "strong", "a", "span"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth and not self.hidden:
            self.parts.append(data)

    @classmethod
    def text(cls, page):
        parser = cls()
        parser.feed(page)
        parser.close()
        return " ".join("".join(parser.parts).split())


def test_op4(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    pages = spark.read.parquet(f"{path}/pages.parquet").collect()
    out = {r["page_id"]: r for r in H.op4_html_text(spark, path).collect()}
    assert len(out) == len(pages)
    for p in pages:
        got = out[p["page_id"]]
        assert got["url"] == p["url"] and got["n_chars"] == len(got["text"])
        assert got["text"] == Articles.text(p["html"])


def test_markup_by_the_standard():
    texts = lambda page: [b.text for b in H.blocks(page)]
    assert texts("<!-->a<p>b<!--->c<!-- x --!>d<!-- <p>no --> e<!---->f") == ["a", "bcd ef"]
    assert texts("<p title=it's>First<p a = >x<p a=\"x>y\">z") == ["First", "x", "z"]
    assert texts("</ no>a</3>b</>c<!doctype html>d<?xml?>e") == ["abcde"]
    assert texts('<p class="a"id=b/>one<p =">two<p a=b"c d>three') == ["one", "two", "three"]
    assert texts("<script><!-- <script> </script> no --></script>yes<script>if (a<!--b) 1;</script>too") == ["yes", "too"]
    assert texts("<style></styles>no</style >a<textarea><p>no</textarea\n x=1>b<title>c</title/>d") == ["a", "b", "d"]
    assert texts("<p>last <b class='open") == ["last"]
    assert H._named(""" class="Main siteNav" data-id=no id='x1' role = banner""") == ("banner", "main", "nav", "site", "x")
    assert H._named(" title=class=no id=it's") == ("it", "s")


def test_deep_and_broken_pages_take_time_by_their_length():
    import resource
    import time

    H.trained()
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    for page in ("<div>a" * 100_000, "<b>" * 50_000 + "<p>x" * 50_000, "<div>" * 50_000 + "</span>" * 50_000 + "a", "".join(f"<div class=c{i}x{chr(97 + i % 26) * (i % 40)}>a" for i in range(50_000)), "<!--" * 100_000, "<p a=\"" * 50_000, "<" * 200_000, "<a " * 100_000, "<script>" + "<!--<script>" * 50_000):
        H.trained().text(page)
    assert time.perf_counter() - began < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


class Main(Articles):
    """What stands in the element of the id, where a page has no <article>."""

    def handle_starttag(self, tag, attrs):
        if self.depth and tag not in H.VOID:
            self.depth += 1
        elif dict(attrs).get("id") == "story":
            self.depth = 1
        self.hidden += tag in ("script", "style")
        if tag not in ("b", "i", "em", "strong", "a", "span", "img"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= self.depth > 0
        self.hidden -= tag in ("script", "style")
        if tag not in ("b", "i", "em", "strong", "a", "span"):
            self.parts.append(" ")


def test_pages_without_an_article_element():
    """Pages of another make than the training's, read by the standard library's parser."""
    rng = random.Random(5)
    right = total = 0
    for _ in range(60):
        say = lambda n: " ".join(rng.choice("river stone morning letter window garden quiet silver winter corner".split()) for _ in range(n))
        body = "".join(f"<p title=it's>{say(rng.randint(15, 60)).capitalize()} &amp; {say(3)}.</p>" if rng.random() < 0.8 else f"<h2>{say(4)}</h2><p>{say(30)}.</p>" for _ in range(rng.randint(3, 9)))
        page = f"""<!DOCTYPE html><html><head><title>{say(3)}</title></head><body class=page><div class="menu nav"><ul><li><a href="/a">{say(1)}</a></li><li><a href="/b">{say(2)}</a></li></ul></div>
        <!--><div class=content id=story>{body}<script>var a = "<p>" + 1;</script></div><div class="sidebar widget"><h3>{say(2)}</h3><ul><li><a href=/x>{say(3)}</a></li></ul></div>
        <div id="footer" class="footer">&copy; {say(3)}. All rights reserved.</div></body></html>"""
        want = Main.text(page.replace("<!-->", ""))
        right += H.trained().text(page) == want
        total += 1
    assert right / total > 0.9


def test_slashes_close_nothing_but_foreign_elements():
    texts = lambda page: [(b.text, round(b.linked, 2)) for b in H.blocks(page)]
    assert texts("<script src=/x/>code</script><p>a") == [("a", 0.0)]
    assert texts("<a href=/foo/>link</a>") == [("link", 1.0)]
    assert texts("<div/>a<b/>c</div>d") == [("ac", 0.0), ("d", 0.0)]
    assert texts("x<svg viewBox='0 0 1 1'/>y<svg><path d='m0'/>z</svg>w") == [("xyw", 0.0)]
    assert texts("a<img src=x>b<br/>c<wbr>d") == [("ab cd", 0.0)]


def test_odd_pages(spark):
    """Nulls, a very long page, repeated rows, an identifier that is null, and columns with clashing names."""
    words = "Words of the long text go on and on. " * 20
    long = "<nav><a href=1>menu</a></nav><article>" + f"<p>{words}</p>" * 3000 + "</article><footer>&copy; all rights</footer>"
    rows = [(1, None, None, "a"), (2, "u", "", None), (3, "v", long, "t"), (4, "w", "<p>x", "t"), (4, "w", "<p>x", "t"), (None, "w", "<article><p>Only this text here.</p></article>", "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.extract(frame).collect()
    assert len(out) == 6 and [r["text"] for r in out[:2]] == ["", ""] and [r["n_chars"] for r in out[:2]] == [0, 0]
    assert out[2]["text"] == " ".join([words.strip()] * 3000)
    assert out[3] == out[4] and out[5]["text"] == "Only this text here."
    assert H.extract(frame.limit(0)).count() == 0
