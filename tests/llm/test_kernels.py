"""The numeric kernels, without Spark."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import decontaminate, extract, language, simhash, suffixarrays, suffixtrees, toxicity, windows
from tests.llm import brute


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(s):
    assert suffixarrays.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 12), st.lists(st.binary(min_size=0, max_size=9), min_size=1, max_size=6))
def test_window_classes_of_bytes(width, parts):
    contents = [(p + b"abababababab")[: width + len(p) % 5] for p in parts]
    counts = np.array([len(c) - width + 1 for c in contents])
    found = suffixarrays.window_classes(contents, counts, width).tolist()
    wanted = [c[i : i + width] for c in contents for i in range(len(c) - width + 1)]
    assert len(set(zip(found, wanted, strict=True))) == len(set(found)) == len(set(wanted))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 9), st.lists(st.lists(st.sampled_from(["a", "b", "cc"]), min_size=9, max_size=14), min_size=1, max_size=5))
def test_window_classes_of_words(width, parts):
    counts = np.array([len(p) - width + 1 for p in parts])
    found = suffixtrees.window_classes([" ".join(p).encode() for p in parts], counts, width).tolist()
    wanted = [tuple(p[i : i + width]) for p in parts for i in range(len(p) - width + 1)]
    assert len(set(zip(found, wanted, strict=True))) == len(set(found)) == len(set(wanted))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 9, 300)
    parts = [np.concatenate([rng.integers(0, 9, n), shared, rng.integers(0, 9, 50)]) for n in (0, 17, 333)]
    values = np.concatenate(parts).astype(np.uint64)
    ends = np.cumsum([len(p) for p in parts])
    first, count, anchor = windows.anchor_runs(values, ends, suffixarrays.KIND)
    of = np.full(len(values), 0, np.uint64)
    for f, c, a in zip(first, count, anchor, strict=True):
        of[f : f + c] = a
    at = [0, len(parts[0]) + 17, len(parts[0]) + len(parts[1]) + 333]
    for i in range(201):
        assert of[at[0] + i] == of[at[1] + i] == of[at[2] + i] != 0
    assert count.sum() == sum(len(p) - 99 for p in parts)


def test_fingerprint_cases():
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \t\n") == 0
    docs = {0: "One two", 1: "one  TWO", 2: "a b c d e f g h", 3: None}
    assert {(d, f"{simhash.fingerprint((t or '').encode()):016x}") for d, t in docs.items()} == {r[:2] for r in brute.simhash(docs)}


def test_near_finds_all_pairs_and_spanning_keeps_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    found = np.unique(np.concatenate([base, base ^ np.uint64(0b111), base ^ np.uint64(1 << 40)]))
    a, b = map(np.concatenate, zip(*simhash.near(found, found, 4, size=16), strict=True))
    wanted = {(int(x), int(y)) for x in found for y in found if x < y and (int(x) ^ int(y)).bit_count() <= 4}
    assert {(min(int(x), int(y)), max(int(x), int(y))) for x, y in zip(a, b, strict=True)} == wanted
    roots, others = simhash.spanning(a, b)
    assert len(roots) == len(set(others.tolist())) == 80
    forest = simhash.linked(found, found, 4, held=10)
    assert len(forest[0]) == 80 and {frozenset(p) for p in zip(*forest, strict=True)} <= {frozenset(p) for p in zip(*simhash.spanning(a, b), strict=True)}


def test_clusters_do_not_fill_memory():
    bits = [np.uint64(1 << i) for i in range(64)]
    cluster = np.unique(np.array([x | y for x in bits for y in bits], np.uint64))  # all within four bits of each other: 2.2 million pairs
    a, b = simhash.linked(cluster, cluster, 4)
    assert len(a) == len(cluster) - 1 and max(len(x) for x, _ in simhash.near(cluster, cluster, 4)) <= simhash.SUBTILE**2


def test_blocks_lose_no_pair():
    rng = np.random.default_rng(2)
    assert [simhash.block_count(n, 4, 4096) for n in (10, 10**7, 10**8, 10**10, 10**12)] == [5, 5, 6, 7, 8]
    for blocks in (5, 6, 7, 8):
        masks = simhash.block_keys(4, blocks)
        for _ in range(200):
            change = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
            assert any(not change & m for m in masks)


def test_benchmark_windows():
    assert decontaminate.windows(b"A b, c", 2) == [(b"a", b"b"), (b"b", b"c")] and decontaminate.windows(b"one", 2) == [(b"one",)]
    assert decontaminate.windows(b" .", 2) == [] and decontaminate.words("Été\x00x-9".encode()) == ["Été".encode().replace(b"t", b"t"), b"x", b"9"]


PAGE = (
    "<!doctype html><html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>"
    "<main><article class='post'><h1>Ti&amp;tle</h1><p>One <b>bo</b>ld<br>two<p>Three &lt;x&gt;<aside>side</aside><div class='ad-box'>buy</div><form>f<input></form>"
    "<ul><li>a<li>b</ul><!-- no --></article><section id=comments><p>me too</p></section></main><footer>(c)</footer></body></html>"
)


def test_page_text():
    assert extract.Page(PAGE).text() == "Ti&tle One bold two Three <x> a b"
    assert extract.Page("").text() == "" and extract.Page("plain text").text() == "plain text"
    assert extract.Page("<div><p>a</div><p>b</i></p>").text() == "a b"
    assert extract.Page("<article><p>cut off <b>here").text() == "cut off here"
    assert extract.Page("<body><div class=menu>m m m m m</div><div class=content><p>long enough text of the page</p></div></body>").text() == "long enough text of the page"


def test_broken_pages_are_read_in_linear_time():
    import time

    pieces = ["<a ", "<div>", "</p>", "<div class=x>t", "<a '>' ", "<!", "<p \"", "<i '", "<article>x", "</", "<script>", "<li>a<ul>", "<span hidden>y"]
    took = {}
    for piece in pieces:
        for size in (100_000, 1_000_000):
            began = time.process_time()
            extract.Page(piece * (size // len(piece))).text()
            took[piece, size] = time.process_time() - began
    assert all(took[p, 1_000_000] < 25 * took[p, 100_000] + 1 for p in pieces), took


def test_tags():
    found = lambda source: [(name, closes, attributes) for _, _, name, closes, attributes in extract.tags(source)]
    assert found("<a b='>' c=\">\">x</A ><br/>") == [("a", False, " b='>' c=\">\""), ("a", True, " "), ("br", False, "/")]
    assert found("<a b=\"x<p>") == [("a", False, " b=\"x"), ("p", False, "")] and found("1 < 2 <3") == []
    assert found("<!-- <a> --><![CDATA[<b>]]><!x><?y><a") == [("", False, "")] * 4 + [("a", False, "")]
    assert extract.Page("a <!-- b").text() == "a" and extract.Page("<p>a</ b>c").text() == "ac"


def test_template_order():
    page = extract.Page("<body><div class=a>x</div><div class=b>y</div></body>")
    first, second = (p for p, t in zip(page.paths, page.tags, strict=True) if t == "div")
    assert page.ordered({first: (7, 0.2), second: (7, 0.8)}) == {first: 7, second: 7}
    assert page.ordered({first: (7, 0.8), second: (7, 0.2)}) == {} and page.ordered({first: (7, 0.8), second: (8, 0.2)}) == {first: 7, second: 8}


def test_language_vectors():
    texts = ["the cat", None, "123", "", "x" * 900_000, "the cat"]
    vectors, lettered = language.document_vectors(texts, 64, 1)
    assert lettered.tolist() == [True, False, False, False, True, True]
    assert (vectors[0] == vectors[5]).all() and not vectors[1].any()
    assert language.crc(0) == 4 and language.crc(12345) in range(5)


def test_every_letter_has_a_vector_of_its_own():
    letters = np.array([ord(c) for c in "abcäжあ"] + list(range(0x4E00, 0x4E00 + 3000)))
    v = language.letter_vectors(letters, 1024, 42).astype(np.int32)
    assert np.abs(v @ v.T - 1024 * np.eye(len(v))).max() < 220, "nearly orthogonal"
    assert (language.letter_vectors(letters[::-1], 1024, 42)[::-1] == v).all()


def test_bundles_do_not_depend_on_grouping(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(chr(int(c)) for c in rng.integers(0x4E00, 0x4E00 + 500, n)) + " abc" * (n % 5) for n in (3, 40, 700, 0, 90)]
    whole, _ = language.document_vectors(texts, 128, 1)
    for text, vector in zip(texts, whole, strict=True):
        assert (vector == language.gram_vectors(language.grams(text), 128, 1).sum(axis=0)).all()
    for name, value in (("GROUP_LETTERS", 50), ("GROUP_TEXTS", 2), ("STEP", 7)):
        monkeypatch.setattr(language, name, value)
        assert (language.document_vectors(texts, 128, 1)[0] == whole).all()


def test_logistic_chain():
    rng = np.random.default_rng(0)
    dense = (rng.random((400, 5)) < 0.3).astype(float)
    y = dense[:, 0]
    x = toxicity.Rows(*np.nonzero(dense[:, :4]), 4, dense[:, 4:])
    w = toxicity.fit_logistic(x, y)
    assert np.allclose(x.times(w), dense @ w[:-1] + w[-1]) and np.allclose(x.back(y), [*(dense.T @ y), y.sum()])
    assert ((x.times(w) > 0) == (y > 0)).mean() == 1.0
    some, used = np.arange(400) % 3 == 0, np.array([True, False, True, True])
    assert np.allclose(x.only(some, used).times(w), dense[some] @ np.where([*used, True], w[:-1], 0) + w[-1])
    chain = toxicity.Chain(["a", "b"], {"w:bad": 0}, [np.array([9.0, -4.0]), np.array([0.0, 9.0, -4.0])])
    p = chain.predict([chain.numbers("so BAD"), chain.numbers("fine"), chain.numbers(None)])
    assert (p[:, 1] > 0.5).tolist() == [True, False, False]
