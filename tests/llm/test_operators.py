"""The operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import hashlib
import random
import re
import struct
import zlib
from itertools import combinations
from uuid import uuid4

import numpy as np
import pytest

from factloom.llm import bloom_lm, bpe, chat, decontaminate, html_text, kd_shards, ngram_join, quality, tiff, token_scan
from factloom.llm.common import remainder, shared_folder

P = pytest.importorskip("public_tokenizers")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def texts():
    made = np.random.default_rng(3)
    base = [" ".join(made.choice(WORDS, 60)) for _ in range(6)]
    near = [b.replace("alpha", "alfa", 1) for b in base]
    return [None, "", " \n", "one", "One", "one two", *base, *near, base[0], base[0] + " more", "long " * 3000, "été ǅ 漢字"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, size int")


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.WordBpe(path)
    for text in [t or "" for t in texts()] + ["a" * 2000, "x<|endoftext|>ΑΣ İ", "it's 12 \x1c é", "internationalization" * 90]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == (" ".join(map(str, ids)), len(ids))
        assert ours.token_text(ids) == theirs.decode(ids, skip_special_tokens=False)
    assert "".join(ours.text(ours.encode("héllo 漢字")[0].split())) == "héllo 漢字 "


def test_stream_equals_whole_merge():
    merges = bpe.Merges([("a", "b"), ("b", "a"), ("ab", "ab"), ("a", "a"), ("abab", "a")])
    made = np.random.default_rng(1)
    for _ in range(200):
        symbols = list(made.choice(["a", "b"], made.integers(0, 400)))
        assert list(merges.stream(iter(symbols))) == list(merges.stream(symbols)) == merges.merge(symbols)
        few = symbols[: merges.SHORT]
        merges.SHORT = 0
        by_heap = merges.merge(few)
        del merges.SHORT
        assert merges.scan(list(few)) == by_heap


def test_stream_of_long_nested_tokens_ends():
    made = np.random.default_rng(2)
    for _ in range(40):
        known, rules = ["a", "b"], []
        for _ in range(made.integers(1, 60)):
            # tokens grow from the left, from the right or from two others
            x, y = known[made.choice([-1, made.integers(len(known))])], known[made.integers(len(known))]
            x, y = (x, made.choice(["a", "b"])) if made.random() < 0.6 else (x, y) if len(x + y) < 400 else ("a", "b")
            rules.append((str(x), str(y)))
            known.append(str(x + y))
        merges = bpe.Merges(rules)
        symbols = list(made.choice(["a", "b"], made.integers(0, 1500), p=[0.8, 0.2]))
        assert list(merges.stream(iter(symbols))) == merges.merge(symbols)
        merges.lookahead = max(merges.lookahead, 1)
    nested = bpe.Merges([("a" * k, "a") for k in range(1, 100)])
    nested.lookahead = 1  # the block is shorter than a token
    assert "".join(nested.stream(["a"] * 1000)) == "a" * 1000


def test_stream_holds_a_block():
    merges = bpe.Merges([("a", "b"), ("ab", "ab"), ("abab", "a")])
    taken, given, most = 0, 0, 0

    def symbols():
        nonlocal taken
        for k in range(50_000):
            taken += 1
            yield "ab"[k % 2]

    for t in merges.stream(symbols()):
        given += len(t)
        most = max(most, taken - given)
    assert given == 50_000 and most <= 4 * merges.lookahead + 64


def test_bpe_by_pieces(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.WordBpe(path)
    monkeypatch.setattr(bpe.WordBpe, "WINDOW", 7)
    for text in [t or "" for t in texts()] + ["  a b  \u3000c ", "x <|endoftext|> y<|endoftext|>", "one\x1ctwo  three", " " * 50]:
        encoded = theirs.encode(text, add_special_tokens=False).ids
        wanted = len(encoded), hashlib.sha256(" ".join(map(str, encoded)).encode()).hexdigest(), hashlib.sha256(theirs.decode(encoded, skip_special_tokens=False).encode()).hexdigest()
        assert bpe.digest(ours, text) == wanted and bpe.digest(ours, text, True)[3] == " ".join(map(str, encoded))


def test_decoder_gives_the_same_for_any_parts():
    ours = bpe.WordBpe(P.path("word_bpe_49k.json"))
    ids = ours.encode("héllo 漢字 <|endoftext|> straße 🙂 x")[0].split()
    for plain in (False, True):
        for n in (1, 2, 5):
            state = ours.decoder(plain)
            parts = "".join([state.feed(ids[k : k + n]) for k in range(0, len(ids), n)]) + state.end()
            state = ours.decoder(plain)
            assert parts == state.feed(ids) + state.end()


def test_tiff_round_trip_and_packings(docs):
    wanted = {i: tiff.payload(t)[1] for i, t in enumerate(texts())}
    read = tiff.pages(tiff.store_texts(docs), [("doc_id", "bigint"), ("n_bytes", "bigint")]).orderBy("doc_id", "page_no").collect()
    assert not any(r["error"] for r in read) and sum(r["last"] for r in read) == len(wanted)
    for i, data in wanted.items():
        of = [r for r in read if r["doc_id"] == i]
        assert b"".join(bytes(r["samples"]) for r in of) == data and [r["page_no"] for r in of] == list(range(-(-len(data) // (64 * tiff.PAGE_ROWS))))
        assert of[-1]["last"] and (of[-1]["read_bytes"], of[-1]["read_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
    # a text of many pages meets every form
    long = b"".join(b"line %d of many, " % k for k in range(20_000))
    file = tiff.write_tiff(tiff.text_pages(data := tiff.payload(long.decode())[1]))
    kinds = {(f[tiff.COMPRESSION][0], tiff.TILE_OFFSETS in f, f[tiff.PREDICTOR][0]) for _, f in tiff.directories(file)}
    assert kinds == set(tiff.FORMS) and b"".join(tiff.page_samples(file, *d).tobytes() for d in tiff.directories(file)) == data
    assert tiff.unpack_bits(b"\x02abc\xfed\x80") == b"abcddd"
    # codes 256, 'a', 258, 'b', 257 in nine bits each
    bits = "".join(f"{c:09b}" for c in (256, 97, 258, 98, 257))
    assert tiff.unpack_lzw(int(bits.ljust(48, "0"), 2).to_bytes(6, "big")) == b"aaab"


@pytest.mark.parametrize("letters", [256, 4, 2, 1])
def test_packings_give_back_what_was_packed(letters):
    rng = random.Random(letters)
    for n in [*range(70), 128, 129, 255, 1000, 3836, 3837, 3838, 12_000, 60_000]:  # around full tables and packets
        data = bytes(rng.randrange(letters) for _ in range(n))
        assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data and tiff.unpack_bits(tiff.pack_bits(data, 64)) == data
    # every file of pages of odd sizes is read back, whatever the form
    for form in tiff.FORMS:
        page = np.array([rng.randrange(letters) for _ in range(37 * 100)], np.uint8).reshape(100, 37)
        file = tiff.write_tiff([(page, form), (page[:5, :3], form)])
        assert [tiff.page_samples(file, *d)[..., 0].tolist() for d in tiff.directories(file)] == [page.tolist(), page[:5, :3].tolist()]


def test_tiff_tiles_and_damage(spark):
    page = np.arange(32 * 16, dtype=np.uint16).reshape(16, 32) % 251
    tiles = [page[:, x : x + 16].astype(np.uint8).tobytes() for x in (0, 16)]
    packed = [zlib.compress(t) for t in tiles]
    values = [(256, 32), (257, 16), (258, 8), (259, 8), (277, 1), (322, 16), (323, 16)]
    data = b"".join(packed)
    at = 8 + len(data)
    entries = [struct.pack(">HHII", t, 4, 1, v) for t, v in values]
    extra = at + 2 + 12 * 9 + 4
    entries += [struct.pack(">HHII", 324, 4, 2, extra), struct.pack(">HHII", 325, 4, 2, extra + 8)]
    file = struct.pack(">2sHI", b"MM", 42, at) + data + struct.pack(">H", 9) + b"".join(entries) + bytes(4) + struct.pack(">4I", 8, 8 + len(packed[0]), *map(len, packed))
    rows = tiff.pages(spark.createDataFrame([(file,), (b"no",), (None,)], "media binary")).collect()
    assert bytes(rows[0]["samples"]) == page.astype(np.uint8).tobytes()
    assert rows[1]["error"] and rows[2]["error"]


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()


def test_jaccard_components(docs):
    sets = {i: shingles(t, 4) for i, t in enumerate(texts())}
    comp = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 85 * len(sets[a] | sets[b]):
            comp = {i: comp[a] if c == comp[b] else c for i, c in comp.items()}
    least = {c: min(i for i in comp if comp[i] == c) for c in comp.values()}
    found = ngram_join.jaccard_components(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {i: (len(sets[i]), least[comp[i]]) for i in sets}
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(7, " ".join((texts()[6]).split()[5:25])), (8, "One"), (9, None), (10, "漢字, ")], "item_id bigint, text string")
    plain = decontaminate.decontaminate(docs, items).collect()
    blocks = decontaminate.decontaminate(docs, items, max_windows=2).collect()
    assert sorted(plain) == sorted(blocks)
    by = {r["doc_id"]: r for r in plain}
    assert by[6]["hit_words"] == list(range(5, 25)) and by[6]["items"] == [7]
    assert by[3]["items"] == by[4]["items"] == [8] and by[0]["n_words"] == 0
    assert 6 not in {r["doc_id"] for r in decontaminate.clean_documents(docs, items).collect()}
    assert decontaminate.remove_spans("a bad, word", [1]) == "a word"


def test_shards_are_near_equal(spark):
    rows = spark.createDataFrame([(i, 50 + i % 7, 5) for i in range(2000)], "doc_id bigint, size bigint, d bigint")
    got = kd_shards.with_slots(kd_shards.shard(rows, ["d"], 7)).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 7 and sums.max() - sums.min() < 200
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert kd_shards.shard(rows.limit(0), ["d"], 7).count() == 0


@pytest.mark.parametrize("room", [1_000_000, 3])
def test_language_model_counts_exactly(docs, room):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\n"] for t in texts()]
    flat = [w for t in tokens for w in t]
    count = {w: flat.count(w) for w in set(flat)}
    got = {r["doc_id"]: r for r in bloom_lm.score(docs, bloom_lm.train(docs, table_rows=room)).collect()}
    for i, t in enumerate(tokens):
        base = sum(np.log10((count[w] + 1) / (len(flat) + len(count) + 1)) for w in t)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), len(t), len(flat))
        assert abs(got[i]["base_score"] - base) < 1e-6 * abs(base) and got[i]["score"] < 0


def test_quality_learns(spark):
    made = np.random.default_rng(5)
    good = [". ".join(" ".join(made.choice(WORDS, 8)) for _ in range(5)) + "." for _ in range(120)]
    bad = ["### ".join(made.choice(WORDS, 30)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)] + [(3, None)], "doc_id bigint, quality int")
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([*rows, (500, None)], "doc_id bigint, text string")
    model = quality.fit_quality(docs, labels, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r["score"] for r in quality.with_quality(docs, model).collect()}
    held = [i for i in range(180) if i % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == (i < 120) for i in held]) > 0.95 and 0 <= got[500] <= 1
    assert quality.fit_quality(docs, labels.limit(0), F.lit(True)).score(quality.matrix(["x"]))[0] > 0.7


def test_main_text(spark):
    page = "<html><body><nav><p>Menu</p></nav><div class='ad'>Buy.</div><article><h1>A &amp; B</h1><p><b>One\n two.<br>Three.<p>Four.</p></article><div class=comments><p>Me too.</p></div><footer>(c)</footer></body></html>"
    rows = [(1, "https://h.example/a", page), (2, "https://h.example/b", page), (3, None, None), (4, "x", "no markup <"), (5, "y", "")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "A & B\n\nOne two. Three.\n\nFour.", 2: "A & B\n\nOne two. Three.\n\nFour.", 3: "", 4: "no markup <", 5: ""}


def test_digests_of_null_and_empty(docs):
    rows = {r["doc_id"]: r for r in bpe.digests(docs, P.path("word_bpe_49k.json")).collect()}
    assert rows[0]["n_tokens"] == 0 and rows[0]["ids_sha256"] == rows[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("segment", [10**6, 300])
def test_filter_grows_beyond_the_broadcast(docs, monkeypatch, segment):
    monkeypatch.setattr(bloom_lm, "SEGMENT", segment, raising=False)
    monkeypatch.setattr(bloom_lm, "ROUTED", 100, raising=False)
    whole, apart = bloom_lm.train(docs), bloom_lm.train(docs, filter_bytes=700)
    wanted = {r["doc_id"]: r for r in bloom_lm.score(docs, whole).collect()}
    got = bloom_lm.score(docs, apart).collect()
    assert len(got) == len(wanted)
    for r in got:
        assert (r["n_tokens"], r["n_known"]) == (wanted[r["doc_id"]]["n_tokens"], wanted[r["doc_id"]]["n_known"])
        assert abs(r["score"] - wanted[r["doc_id"]]["score"]) < 1e-9 * abs(r["score"])
    assert whole[0].found is not None and apart[0].found is None and apart[3] and not whole[3] and (apart[4] > 1) == (segment == 300)


BODY = "<h1>T</h1><p>One sentence of it. And another one.</p><p>The last of them.</p>"
WANTED = "T\n\nOne sentence of it. And another one.\n\nThe last of them."
AROUND = "<nav><p>Menu</p></nav><div class='comments'><article class='comment-body'><p>Me too. " + "So much. " * 40 + "</p></article></div><footer>(c)</footer>"


@pytest.mark.parametrize("outer", ["div class='content has-sidebar'", "div class=no-comments", "div class='header-fixed'", "div id='page-header-wrap'", "form", "div class=share", "nav"])
def test_a_template_named_like_boilerplate_keeps_its_article(outer):
    name = outer.split()[0]
    for inner in ("article", "main"):
        page = html_text.Page(f"<body><{outer}><{inner}>{BODY}<div class=comments><p>{'Me too. ' * 40}</p></div></{inner}></{name}>{AROUND}</body>")
        assert page.text([]) == WANTED
    if name != "nav":
        assert html_text.Page(f"<body><{outer}>{BODY}</{name}><footer>(c)</footer></body>").text([]) == WANTED


LEAD = "<p>The lead of it, one more sentence.</p>"
LINKS = "<ul>" + "<li><a href=x>Some other post of ours</a>" * 4 + "</ul>"


@pytest.mark.parametrize("wrap", ["<article class=post>{0}</article>", "<main><div class=entry>{0}</div></main>", "<main><article><section class=body>{0}</section></article></main>", "<div class=page-header-wrap><article>{0}</article></div>"])
def test_an_article_keeps_its_own_header_and_sections(wrap):
    text = lambda inner: html_text.Page(f"<body>{wrap.format(inner)}{AROUND}</body>").text([])
    for head in ("<header class=entry-header><h1>My Title</h1></header>", "<div class=post-header><h1><a href=x>My Title</a></h1></div>", "<div class='article-header'><h1>My Title</h1></div>", "<div class=header><h2>My Title</h2></div>"):
        assert text(f"{head}{BODY}") == f"My Title\n\n{WANTED}"
    assert text(f"<div class=article-header><h1>My Title</h1>{LEAD}</div>{BODY}") == f"My Title\n\nThe lead of it, one more sentence.\n\n{WANTED}"
    assert text(f"{BODY}<section class=related-work><h3>Related</h3>{LEAD}</section>") == f"{WANTED}\n\nRelated\n\nThe lead of it, one more sentence."
    more = "<p>" + "Reader says so. " * 30 + "</p>"
    for gone in (f"<div class=commentlist>{more}</div>", f"<section id=post-comments>{more}</section>", f"<div class=related-posts><h3>More</h3>{LINKS}</div>", "<div class=cookie-notice><p>We use cookies.</p></div>", f"<div class=entry-footer>{LINKS}</div>", f"<nav>{LINKS}</nav>", f"<div class=share-buttons>{LINKS}</div>", "<aside><p>Aside.</p></aside>", "<form><p>Name?</p></form>"):
        assert text(f"{BODY}{gone}") == WANTED


@pytest.mark.parametrize("depth", [3, 600, 5000])
def test_depth_changes_nothing(depth):
    inner = f"<nav>{LINKS}</nav><div class=comments><p>Me too.</p></div>{BODY}"
    assert html_text.Page(f"<body><article>{'<div>' * depth}{inner}{'</div>' * depth}</article>{AROUND}").text([]) == WANTED


def test_a_rare_template_of_a_host_votes(spark):
    page = "<body><div class={0}><p>" + "One sentence of it. " * 8 + "</p></div><div class=x{0}><p>" + "other words, " * 30 + "</p></div></body>"
    rows = [(10 * k + i, "https://a.example/x", page.format(f"t{c}").replace("x" + f"t{c}", "zz")) for k, c in enumerate("abcdef") for i in range(3)]
    found = html_text.host_paths(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()[0]["paths"]
    assert 2 <= len(found) <= 50 and found == sorted(found, key=found.index) and len({tuple(p) for p in found}) == len(found)


def test_odd_quotes_take_linear_time():
    import time

    began = time.time()
    for page in ("<a b=\"x>t <i c='y>u " * 60_000, "<p class=menu>" * 60_000 + "x", "<b>" * 60_000 + "</i>" * 60_000, "<div class='nav share'><p>x" * 30_000, "<i>" + "<b>x</i>" * 60_000):
        html_text.Page(page).text([])
    assert time.time() - began < 30


def test_boilerplate_is_still_left_out():
    assert html_text.Page(f"<body><article>{BODY}</article>{AROUND}</body>").text([]) == WANTED
    assert html_text.Page(f"<body><main><article>{BODY}</article>{AROUND}</main></body>").text([]) == WANTED
    assert html_text.Page("<body><nav>Menu</nav></body>").text([]) == ""
    assert html_text.Page("<p>One <span class=share>Tweet</span>two.</p>").text([]) == "One two."


def test_a_self_closed_svg_is_empty():
    assert html_text.Page("<body><article><p>A <svg class='x' /> b.</p><p>C <math/>d.</p><svg><path/>no</svg></article></body>").text([]) == "A b.\n\nC d."


PARTS = ["<article><h1>T</h1><div class=wrap><p>Lead.</p><div class=content>{0}</div></div></article>", "<article><div class=entry><h1>T</h1><p>Lead.</p><section class=a>{0}</section><section class=b><p>End.</p></section></div></article>", "<main><h1>T</h1><p>Lead.</p><section class=a>{0}</section><section class=b><p>End.</p></section></main>", "<main><h1>T</h1><article><p>Lead.</p>{0}</article></main>", "<div class=entry><h1>T</h1><div class=wrap><p>Lead.</p><div class=content>{0}</div></div></div><div class=links><ul><li>Some link<li>Another link</ul></div>", "<h1>T</h1><p>Lead.</p><section class=a>{0}</section><section class=b><p>End.</p></section>"]


def test_nested_templates_give_the_whole_article(spark):
    long = [f"Sentence {i} of it. " * 9 for i in range(8)]
    rows = [(10 * k + i, f"https://h{k}.example/{i}", "<html><body><nav>Menu</nav>" + part.format("".join(f"<p>{t}</p>" for t in long)) + "<footer>(c)</footer></body></html>") for k, part in enumerate(PARTS) for i in range(3)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        end = ["End."] if "End." in PARTS[r["page_id"] // 10] else []
        assert r["text"].split("\n\n") == ["T", "Lead.", *(t.strip() for t in long), *end]


def test_blocks_of_windows_keep_rows_apart(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (1, "gamma delta"), (None, "alpha x"), (None, "y delta")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "alpha"), (8, "delta"), (9, "beta")], "item_id bigint, text string")
    order = lambda df: sorted(map(str, df.collect()))
    plain = order(decontaminate.decontaminate(docs, items))
    assert len(plain) == 5 and plain == order(decontaminate.decontaminate(docs, items, max_windows=1))


def test_items_without_an_id_are_searched(spark, docs):
    items = spark.createDataFrame([(None, "été"), (8, "One"), (None, "two")], "item_id bigint, text string")
    for how in ({}, {"max_windows": 1}):
        by = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, items, **how).collect()}
        assert by[5]["hit_words"] == [0, 1] and by[5]["items"] == [8] and by[len(texts()) - 1]["hit_words"] == [0]


def test_encode_decode_gives_the_text(docs):
    rows = {r["doc_id"]: r for r in bpe.encode_decode(docs, P.path("word_bpe_49k.json")).collect()}
    assert rows[5]["decoded_text"] == "one two " and rows[0]["decoded_text"] == "" and "漢字" in rows[len(texts()) - 1]["decoded_text"]


def test_equal_rows_are_divided(spark):
    rows = spark.createDataFrame([(7, 50, 5)] * 2000, "doc_id bigint, size bigint, d bigint")
    got = kd_shards.with_slots(kd_shards.shard(rows, ["d"], 8)).toPandas()
    assert got.groupby("shard").size().between(240, 260).all() and got["shard"].nunique() == 8
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])


def tiff_file(fields, data=b""):
    """A little-endian file of one page with the given fields of one number each."""
    entries = b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in fields)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data + struct.pack("<H", len(fields)) + entries + bytes(4)


PLAIN = {256: 4, 257: 2, 258: 8, 259: 1, 273: 8, 277: 1, 278: 2, 279: 8}


@pytest.mark.parametrize("change", [{256: 0}, {257: 1 << 30}, {256: 1 << 31, 257: 1 << 31}, {259: 99}, {258: 7}, {266: 2}, {284: 2, 277: 3}, {317: 3}, {322: 0, 323: 16, 324: 8, 325: 8}, {273: 1 << 20}, {279: 3}, {259: 8}, {278: 0}])
def test_damaged_pages_are_error_rows(spark, change):
    file = tiff_file(sorted((PLAIN | change).items()), bytes(range(8)))
    rows = tiff.pages(spark.createDataFrame([(file,), (tiff_file(sorted(PLAIN.items()), bytes(range(8))),)], "media binary")).collect()
    assert rows[0]["error"] and rows[0]["samples"] is None and rows[0]["page_no"] == 0
    assert rows[1]["error"] is None and bytes(rows[1]["samples"]) == bytes(range(8))


def test_broken_directories_are_error_rows(spark):
    whole = tiff_file(sorted(PLAIN.items()), bytes(range(8)))
    files = [whole[:k] for k in (0, 3, 8, 20, 40)] + [struct.pack("<2sHI", b"II", 42, 0), struct.pack("<2sHI", b"II", 42, 1 << 30)]
    assert all(r["error"] for r in tiff.pages(spark.createDataFrame([(f,) for f in files], "media binary")).collect())


def test_pages_of_a_file_are_rows(spark):
    one = tiff_file(sorted(PLAIN.items()), bytes(range(8)))
    second = sorted((PLAIN | {258: 16, 279: 16, 273: len(one)}).items())
    at = len(one) + 16
    file = one[:-4] + struct.pack("<I", at) + np.arange(8, dtype="<u2").tobytes() + struct.pack("<H", len(second)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in second) + bytes(4)
    rows = tiff.pages(spark.createDataFrame([(file,)], "media binary")).collect()
    assert [(r["page_no"], r["width"], r["height"], r["error"]) for r in rows] == [(0, 4, 2, None), (1, 4, 2, None)]
    assert np.frombuffer(bytes(rows[1]["samples"]), "<u2").tolist() == list(range(8))


def test_hosts_can_disagree(spark):
    """A page of a host follows its host's vote, even if another container of it is larger."""
    story, aside = "<p>" + "One sentence of it. " * 12 + "</p>", "<p>" + "Another list stands here, " * 40 + "</p>"
    plain = "<body><div class=story>{0}</div><div class=extra><p>Short one.</p></div></body>"
    rows = [(i, "https://a.example/x", plain.format(story)) for i in range(6)] + [(10 + i, "https://b.example/x", plain.replace("story", "post").format(story)) for i in range(3)]
    rows += [(6, "https://a.example/y", f"<body><div class=story>{story}</div><div class=extra>{aside}</div></body>"), (7, "https://c.example/y", f"<body><div class=story>{story}</div><div class=extra>{aside}</div></body>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[6].startswith("One sentence") and "Another" not in got[6] and "Another" in got[7] and got[12].startswith("One sentence")


def test_class_names_with_slashes_can_win(spark):
    rows = [(i, "https://a.example/x", f"<body><div class='w-1/2'><p>{'One sentence of it. ' * 9}</p></div><div class=b><p>{'x ' * 10 * i}</p></div></body>") for i in range(4)]
    votes = html_text.host_paths(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert ["body", "div.w-#/#"] in [list(p) for p in votes[0]["paths"]]


def test_broken_quotes_take_linear_time():
    import time

    began = time.time()
    assert len(html_text.Page('<a title="x ' * 90_000).text([])) > 1_000_000
    assert html_text.Page("<div>" * 200_000 + "<p>x").text([]) == "x"
    assert time.time() - began < 20


EMPTY = {
    "op1": lambda d: html_text.extract(d.selectExpr("doc_id as page_id", "text as url", "text as html")),
    "op2": lambda d: token_scan.count_tokens(token_scan.write_flat(d, f"{shared_folder(d.sparkSession)}/empty-{uuid4().hex}").where("block is not null")),
    "op3": lambda d: chat.perspectives(d.selectExpr("doc_id as conv_id", "doc_id as turn", "text as role", "text")),
    "op4": lambda d: tiff.pages(tiff.store_texts(d)),
    "op5": lambda d: bpe.digests(d, P.path("word_bpe_49k.json")),
    "op6": ngram_join.jaccard_components,
    "op7": lambda d: decontaminate.decontaminate(d, d.selectExpr("doc_id as item_id", "text")),
    "op8": lambda d: kd_shards.with_slots(kd_shards.shard(d.selectExpr("doc_id", "doc_id as size", "doc_id as d"), ["d"], 5)),
    "op9": lambda d: bloom_lm.score(d, bloom_lm.train(d)),
    "op10": lambda d: quality.with_quality(d, quality.fit_quality(d, d.selectExpr("doc_id", "1 as quality"), remainder("doc_id", 4) != 2)),
}


@pytest.mark.parametrize("name", list(EMPTY))
def test_empty_tables_give_no_rows(docs, name):
    assert EMPTY[name](docs.limit(0)).count() == 0


def test_one_id_with_two_texts_is_two_documents(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, "other words stand here in this one"), (2, base + " more"), (3, base), (None, base), (2, base + " more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 57, 1), (1, 4, 1), (2, 58, 1), (2, 58, 1), (3, 57, 1), (None, 57, None)], key=str)
    kept = sorted((str(r["doc_id"]), r["text"][:5]) for r in ngram_join.one_of_each(docs).collect())
    assert kept == [("1", "other"), ("1", "w0 w1"), ("None", "w0 w1")]


def test_hot_lists_and_copies_lose_no_link(spark):
    """A chain of near copies, a common passage and many short texts, against brute force of pairs and components."""
    made = np.random.default_rng(9)
    passage = " ".join(made.choice(WORDS, 40))
    chain = [[f"c{i}" for i in range(100)]]
    for k in range(40):
        chain.append([*chain[-1]])
        chain[-1][(k * 3) % 100] = f"x{k}"
    texts_ = [" ".join(c) for c in chain] + [passage + " " + " ".join(made.choice(WORDS, 12)) for _ in range(60)] + [" ".join(made.choice(WORDS[:3], made.integers(1, 9))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")
    sets = [shingles(t, 4) for t in texts_]
    links = {(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    comp = list(range(len(sets)))
    for a, b in sorted(links):
        low, high = sorted((comp[a], comp[b]))
        comp = [low if c == high else c for c in comp]
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()} == dict(enumerate(comp))
    pairs, members = ngram_join.jaccard_pairs(docs)
    of = {r["doc_id"]: r["c"] for r in members.collect()}
    assert {tuple(sorted((r["a"], r["b"]))) for r in pairs.collect()} == {tuple(sorted((of[a], of[b]))) for a, b in links if of[a] != of[b]}


def test_windows_equal_brute_force(spark):
    made = np.random.default_rng(4)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    items = [(i, " ".join(made.choice(WORDS, made.integers(0, 25)))) for i in range(40)]
    texts_ = [", ".join([*made.choice(WORDS, 9), *items[made.integers(40)][1].split(), *made.choice(WORDS, 9)]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts_, None, ""])), "doc_id bigint, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    for r in got:
        w, hit, found = words((texts_ + [None, ""])[r["doc_id"]]), set(), set()
        for i, t in items:
            own = words(t)
            for k in range(max(1, len(own) - 9) if own else 0):
                window = own[k : k + 10]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        found.add(i)
        assert (r["n_words"], r["hit_words"], r["items"]) == (len(w), sorted(hit), sorted(found))


def test_held_out_scores_beat_the_base(spark):
    made = np.random.default_rng(2)
    following = {w: made.choice(WORDS, 3) for w in WORDS}

    def text():
        out = [made.choice(WORDS)]
        while len(out) < 80:
            out.append(made.choice(following[out[-1]]))
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(120)], "doc_id bigint, text string")
    got = bloom_lm.score(docs.where("doc_id % 4 = 0"), bloom_lm.train(docs.where("doc_id % 4 <> 0"))).toPandas()
    assert (got["score"] > got["base_score"] + 20).all()


@pytest.mark.parametrize(("kind", "separator"), [("<u2", 65535), ("<u4", 1 << 20)])
def test_documents_cross_blocks_and_groups(spark, docs, kind, separator):
    rows = token_scan.write_flat(docs.coalesce(1), f"{shared_folder(spark)}/flat-{uuid4().hex}", separator, kind=kind, block_tokens=37)
    found = token_scan.count_tokens(rows.where("block is not null"), separator, kind, group=3)
    got = found.join(rows.where("ordinal is not null").select("file", "ordinal", "doc_id"), ["file", "ordinal"]).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len((t or "").encode()) for i, t in enumerate(texts())} and len(got) == len(texts())


def test_files_without_separators(spark):
    block = lambda *tokens: np.array(tokens, "<u2").tobytes()
    rows = [(1, 0, b""), (2, 0, block(5, 6)), (2, 1, block(7)), (2, 2, b""), (3, 0, block(65535)), (3, 1, block(65535, 1)), (3, 2, block(2, 65535)), (3, 3, block(4))]
    got = token_scan.count_tokens(spark.createDataFrame(rows, "file int, block int, tokens binary"), group=2).collect()
    assert sorted(map(tuple, got)) == [(2, 0, 3), (3, 0, 0), (3, 1, 0), (3, 2, 2), (3, 3, 1)]


def plain_views(rows):
    """Per conversation and participant: the whole view, its turns, and the spans of the assistant's texts."""
    safe, out = lambda t: t.replace("<|", "<\\|"), {}
    turns = [(c, t is None, t or 0, safe("unknown" if r is None else r), safe(x or "")) for c, t, r, x in rows]
    for c, view in {(t[0], t[3]) for t in turns if t[3] != "system"}:
        whole, spans = "", []
        for *_, speaker, text in sorted(t[1:] for t in turns if t[0] == c):
            whole += {view: "<|assistant|>", "system": "<|system|>"}.get(speaker, "<|user|>" + speaker) + "\n"
            if speaker == view:
                spans.append((len(whole), len(whole) + len(text) + 1))
            whole += text + "\n"
        out[c, view] = whole, sum(t[0] == c for t in turns), spans
    return out


@pytest.mark.parametrize("part", [1000, 3, None])
def test_perspectives_equal_brute_force(spark, part):
    rng = random.Random(5)
    rows = [(1, 2, "ann", "b"), (1, 1, "bob", "a <|assistant|>"), (1, 0, "system", "be kind"), (None, 0, None, None), (2, 0, "system", "alone"), (1, 1001, "ann", "late"), (1, None, "bob", "when"), (1, None, "bob", "when")]
    rows += [(rng.choice([3, 4, None]), rng.choice([None, *range(12)]), rng.choice(["ann", "bob", "\u00e9ve \U0001f600", "system", "", "<|user|>"]), rng.choice(["", None, "hi", "two\nlines", "\U0001f600 <|"])) for _ in range(120)]
    found = chat.perspectives(spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, view int"), part).collect()
    wanted, got = plain_views(rows), {}
    for r in sorted(found, key=lambda r: (r["part"] is None, r["part"] or 0)):
        whole, n, spans = got.get(key := (r["conv_id"], r["perspective"]), ("", 0, []))
        assert (r["turns_before"], r["chars_before"]) == (n, len(whole))
        assert r["n_masked_chars"] == sum(m["end"] - m["start"] for m in r["mask"])
        got[key] = whole + r["rendered"], n + r["n_turns"], spans + [(m["start"], m["end"]) for m in r["mask"]]
    assert got == wanted and (part is not None or len(found) == len(wanted))


def test_perspectives_of_nothing(spark):
    assert chat.perspectives(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_clean_rows_stay_whatever_their_ids(spark, most):
    passage = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, passage), (2, "one two three"), (3, None), (4, " ".join(f"v{i}" for i in range(11)))], "item_id bigint, text string")
    rows = [(None, f"x {passage}"), (None, "clean"), (5, passage.upper()), (5, "clean too"), (6, None), (7, ""), (8, "so one two three it is"), (8, "so one two three it is"), (9, "clean"), (9, "clean")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, item_id string")
    got = sorted((tuple(r) for r in decontaminate.clean_documents(docs, items, max_windows=most).collect()), key=str)
    assert got == sorted([(i, t, "x") for i, t in rows if t is None or t == "" or t.startswith("clean")], key=str)
    assert decontaminate.clean_documents(docs.limit(0), items).count() == 0 and decontaminate.clean_documents(docs, items.limit(0)).count() == len(rows)


def test_few_links_take_few_tasks(spark, monkeypatch):
    """Components equal brute force in one partition and in many; few links take no task for each partition of each shuffle."""
    made = np.random.default_rng(6)
    links = [(k, k + 1) for k in range(30)] + [(100 + k, 90) for k in range(20)] + [tuple(map(int, made.choice(np.arange(200, 300), 2, replace=False))) for _ in range(60)]
    comp = {i: i for link in links for i in link}
    for a, b in links:
        low, high = sorted((comp[a], comp[b]))
        comp = {i: low if c == high else c for i, c in comp.items()}
    sc, settings = spark.sparkContext, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    edges = spark.createDataFrame(links, "a bigint, b bigint")
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        sc.setJobGroup(group := f"links-{uuid4().hex}", "few links")
        assert dict(ngram_join.components(edges).collect()) == comp
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        status = sc.statusTracker()
        stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
        assert 0 < sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s))) < 200
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        monkeypatch.setattr(ngram_join, "LINKS", 50)
        assert dict(ngram_join.components(edges).collect()) == comp
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.set(key, value)
