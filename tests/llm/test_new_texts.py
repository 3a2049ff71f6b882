"""Pieces by merge rounds and fill-in-middle against brute force, and their edge cases."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from flowsift.llm import infill, pieces
from flowsift.llm.queries import PIECES, QUERIES

SCHEMA = "doc_id long, text string, lang string, ids string, form string, output string, n string"
LONG = "word and more of it " * 20_000
ODD = [
    (1, None, None, "x", None, "y", "z"),
    (2, "", "en", None, "psm", None, None),
    (None, "a b  c\n\n d\te   f", "xx", None, None, None, None),
    (3, "same text twice", "en", "1", "spm", "<P>", "9"),
    (3, "same text twice", "en", "1", "spm", "<P>", "9"),
    (4, LONG, "fr", None, None, None, None),
    (5, "\x00\x1c ▁ ▁▁ x  é漢字🙂� <s></s><0x41>", None, None, None, None, None),
    (6, "holds <S> itself", None, None, None, None, None),
    (7, "thethe" * 4000 + " " * 5000 + "🙂" * 3000, None, None, None, None, None),
]
TEXTS = st.text(alphabet=st.sampled_from(list("aabehtn▁   \n\té漢🙂.,01<>PSM\x00")), max_size=60)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def step(texts, keep=10_000_000):
    known = pieces._Known(pieces.load_vocabulary(PIECES), keep)
    ids, sizes = pieces.encode_step(known, pa.array(texts, pa.string()))
    return np.split(ids, np.cumsum(sizes)[:-1]), pieces.decode_rows(known.vocabulary, ids, sizes)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=6))
def test_rounds_equal_the_library(library, texts):
    ids, decoded = step(texts)
    want = [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [i.tolist() for i in ids] == want
    assert decoded == [library.decode(w).encode() for w in want]


@pytest.mark.parametrize("unit", ["a", " ", "the", "ab ", "=-", "\n", "漢", "🙂", "▁ ", "0f7"])
def test_long_runs_equal_the_library(library, unit):
    text = unit * (60_000 // len(unit) + 7)
    ids, decoded = step([text])
    assert ids[0].tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert decoded[0].decode() == text.replace("▁", " ")


@pytest.mark.parametrize("n", range(40))
def test_runs_of_spaces(library, n):
    texts = [" " * n + "x", "x" + " " * n, " " * n, "a" + " " * n + "the"]
    assert [i.tolist() for i in step(texts)[0]] == [library.encode(t, add_bos=True, add_eos=True) for t in texts]


def test_a_merge_that_a_better_one_follows():
    """Pieces by rank: abx, ab, xab. After the first ab, abx is looked at before the next ab."""
    vocabulary = pieces.Vocabulary.__new__(pieces.Vocabulary)
    a, b, x, ab, abx, xab = range(6)
    table = {(ab, x): (0, abx), (a, b): (1, ab), (x, ab): (2, xab)}
    keys = sorted((l << 32 | r, v) for (l, r), v in table.items())
    vocabulary.keys = np.array([k for k, _ in keys], np.int64)
    vocabulary.ranks = np.array([v[0] for _, v in keys], np.int32)
    vocabulary.merged = np.array([v[1] for _, v in keys], np.int32)
    words = [[a, b, x, a, b], [x, a, b, x, a, b, a, b], [a], [a, b, a, b, x], [x, x]]
    sym, counts = pieces.merge_rounds(vocabulary, np.concatenate(words).astype(np.int32), np.array(list(map(len, words))))

    def queue(word):
        while True:
            pairs = [(table[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in table]
            if not pairs:
                return word
            _, i = min(pairs)
            word = [*word[:i], table[word[i], word[i + 1]][1], *word[i + 2 :]]

    assert [p.tolist() for p in np.split(sym, np.cumsum(counts)[:-1])] == [queue(list(w)) for w in words]


@pytest.mark.parametrize("keep", [0, 400, 10**7])
def test_words_beyond_those_kept(library, keep):
    known = pieces._Known(pieces.load_vocabulary(PIECES), keep)
    for texts in (["a b a", "b a c"], ["c d e f a", "f f d"], ["g a", ""]):
        ids, sizes = pieces.encode_step(known, pa.array(texts))
        got = [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [library.encode(t, add_bos=True, add_eos=True) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 31_999) | st.integers(0, 262), max_size=12), min_size=1, max_size=5))
def test_decoding_any_ids(library, rows):
    got = pieces.decode_rows(
        pieces.load_vocabulary(PIECES), np.array([i for r in rows for i in r], np.uint32), np.array(list(map(len, rows)))
    )
    assert got == [library.decode(r).encode() if r else b"" for r in rows]


def test_pieces_query(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_pieces"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id], add_bos=True, add_eos=True), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids.tolist()).encode()).hexdigest()


def test_pieces_odd_rows(odd, library):
    encoded = pieces.encode_documents(odd, "doc_id", "text", PIECES)
    got = sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in pieces.decode_documents(encoded, PIECES).collect())
    want = []
    for doc_id, text, *_ in ODD:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id or 0, np.array(ids, "<u4").tobytes(), library.decode(ids).encode()))
    assert got == sorted(want)
    assert pieces.encode_documents(odd.limit(0), "doc_id", "text", PIECES).count() == 0
    empty = encoded.selectExpr("doc_id", "n_tokens", "cast(null as binary) AS ids")
    assert {r.decoded for r in pieces.decode_documents(empty, PIECES).collect()} == {None}


@given(st.binary(max_size=40), st.data())
def test_rotation_and_back(data, draw):
    cuts = sorted(draw.draw(st.integers(0, len(data))) for _ in range(3))
    buffer = bytearray(data)
    infill.rotate(buffer, *cuts)
    low, middle, high = cuts
    assert bytes(buffer) == data[:low] + data[middle:high] + data[low:middle] + data[high:]
    infill.rotate(buffer, low, low + high - middle, high)
    assert bytes(buffer) == data


def brute(doc_id, text, transformed=90, suffix_first=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= transformed:
        return n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_infill"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        *want, output = brute(r.doc_id, texts[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == want
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("settings_", [(90, 20), (100, 0), (100, 100), (0, 50)])
def test_infill_odd_rows(odd, settings_):
    moved = infill.fill_in_middle(odd, "doc_id", "text", "1", *settings_)
    rows = infill.restore_texts(moved).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=key)
    assert got == sorted(((d, *brute(d, t, *settings_)) for d, t, *_ in ODD), key=key)
    assert sorted(r.restored for r in rows) == sorted(t or "" for _, t, *_ in ODD)
    assert infill.fill_in_middle(odd.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from(["psm", "spm", "plain"]), st.data())
def test_restoring_whatever_the_cuts(text, form, draw):
    if re.search("<[PSM]>", text) and form != "plain":
        return
    cuts = sorted(draw.draw(st.integers(0, len(text))) for _ in range(2))
    places = [len(text[:c].encode()) for c in cuts]
    out = bytes(infill.transform(text.encode(), form, *places))
    p, m, s = text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]
    want = {"psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}", "plain": text}[form]
    assert out.decode() == want and bytes(infill.restore(out, form)).decode() == text


def test_restoring_null(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "psm", None)], "doc_id long, form string, output string")
    assert [r.restored for r in infill.restore_texts(rows).collect()] == [None, None]
