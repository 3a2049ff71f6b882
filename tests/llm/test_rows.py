"""Row-wise operators against brute force, and their edge cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowsift.llm import attribution, bpe, chat, langid, packing, quality, tokens, toxicity
from flowsift.llm.queries import QUERIES, RANKS, TOKENIZER
from flowsift.llm.tokens import encode_texts, load_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, n_words string"
LONG = "word and more of it " * 20_000
ODD = [
    (1, None, None, None, None, "x", "y"),
    (2, "", "en", "src0", 0, None, None),
    (None, "a b  c\n\n d\te   f", "xx", "src1", 3, None, None),
    (3, "same text here twice or more than that one two three", "en", "src0", 9, None, None),
    (3, "same text here twice or more than that one two three", "en", "src0", 9, None, None),
    (4, LONG, "fr", "src2", len(LONG), None, None),
    (5, "\x1c \x1d x   y 　z  <|endoftext|> é漢字🙂", None, "", 1, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def reference_ids(text):
    return load_tokenizer(TOKENIZER).encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é\n\t   \x1c'stre.1漢🙂")), max_size=40), max_size=6))
def test_batch_encoding_equals_whole_texts(texts):
    got = encode_texts(tokens.Words(load_tokenizer(TOKENIZER)), pa.array(texts, pa.string()))
    assert [list(g) for g in got] == [reference_ids(t) for t in texts]


@pytest.mark.parametrize("keep", [0, 600, 10**7])
@pytest.mark.parametrize("join", [1, 7, 64_000])
def test_words_beyond_those_kept(monkeypatch, keep, join):
    monkeypatch.setattr(tokens, "JOIN_BYTES", join)
    words = tokens.Words(load_tokenizer(TOKENIZER), keep)
    for texts in (["a b a", "b a c"], ["c d e f a\n", "f f d ", " é\u2003"], ["g a", "", "x 漢字🙂 .1 's\u2029"]):
        assert [list(g) for g in encode_texts(words, pa.array(texts))] == [reference_ids(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab é\n\t \x1c'stre.1漢🙂")), max_size=30), max_size=6))
def test_ids_with_ends(texts):
    flat, sizes = tokens.encode_step(tokens.Words(load_tokenizer(TOKENIZER)), pa.array(texts, pa.string()), 1)
    assert [p.tolist() for p in np.split(flat, np.cumsum(sizes)[:-1])][: len(texts)] == [[*reference_ids(t), 1] for t in texts]


@settings(max_examples=300, deadline=None)
@given(
    st.text(alphabet=st.sampled_from(list("ab é\n\t  \x1c'stre.1漢🙂")), max_size=120),
    st.integers(1, 9),
    st.integers(1, 5),
)
def test_tree_equals_direct_encoding(text, leaf, reach):
    encoding, table = bpe.load_encoding(RANKS, public_tokenizers.PATTERN)
    ids = bpe.encode_tree(text, encoding.encode_ordinary, leaf, reach)
    assert ids == encoding.encode_ordinary(text)
    assert bpe.decode_tree(np.array(ids, "<u4"), table, leaf) == text.encode()


def test_bpe_query(spark, sf, documents):
    encoding, _ = bpe.load_encoding(RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in QUERIES["op7_bpe"](spark, sf).collect()}
    for d in documents:
        ids = np.array(encoding.encode_ordinary(d["text"]), "<u4")
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(d["text"].encode()).hexdigest()


def test_bpe_odd_rows(odd):
    out = bpe.decode_documents(
        bpe.encode_documents(odd, "doc_id", "text", RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN
    ).collect()
    assert sorted(bytes(r.decoded) for r in out) == sorted((r[1] or "").encode() for r in ODD)
    assert bpe.encode_documents(odd.limit(0), "doc_id", "text", RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_holds_one_worker_for_each_task(spark, sf):
    plan = QUERIES["op7_bpe"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\b(MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython)\b", plan)) == 1


def test_bpe_round_trip_odd_rows(odd):
    names = ("doc_id", "text", RANKS, public_tokenizers.PATTERN)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, bytes(r.ids))
    both = bpe.decode_documents(bpe.encode_documents(odd, *names), *names[2:])
    once = bpe.round_trip_documents(odd, *names)
    assert once.schema == both.schema and sorted(once.collect(), key=key) == sorted(both.collect(), key=key)
    assert bpe.round_trip_documents(odd.limit(0), *names).count() == 0


def test_bpe_steps_are_bounded_in_bytes():
    texts = ["", None, *["word é " * 150_000] * 4, "a", "word " * 1_000_000, None, "b"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([None, *range(len(texts) - 1)], pa.int64()), pa.array(texts)], names=["doc_id", "text"]
    )
    args = (RANKS, public_tokenizers.PATTERN)
    coded = list(bpe.encode_batches(iter([batch, batch.slice(0, 0)]), *args))
    back = list(bpe.decode_batches(iter(coded), *args))
    assert len(coded) > 2
    for b in back:
        assert b.num_rows == 1 or sum(len(t) for t in b.column(3).to_pylist()) <= tokens.STEP_BYTES
    rows = [r for b in back for r in b.to_pylist()]
    assert [(r["doc_id"], r["decoded"]) for r in rows] == [
        (i, (t or "").encode()) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)
    ]
    assert all(4 * r["n_tokens"] == len(r["ids"]) for r in rows)
    # Null ids stay null, whole batches of them too.
    (none,) = bpe.decode_batches(
        [pa.record_batch([pa.array([1, 1]), pa.array([0, 0]), pa.array([None, None], pa.binary())], names=["doc_id", "n_tokens", "ids"])], *args
    )
    assert none.column(3).to_pylist() == [None, None]


def check_packing(rows, texts, window=packing.WINDOW):
    """rows: of pack(); texts: by doc_id, distinct ids."""
    rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    place = 0
    for r in rows:
        assert r.sequence_id * window + r.offset == place and r.offset + r.length <= window and r.length > 0
        assert (r.continued, r.continues) == (r.start > 0, r.start + r.length < r.doc_tokens)
        place += r.length
    ids = {d: [] for d in texts}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == len(ids[r.doc_id])
        ids[r.doc_id] += np.frombuffer(bytes(r.ids), "<u4").tolist()
    assert ids == {d: [*reference_ids(t or ""), 1] for d, t in texts.items()}


def test_packing_every_id_once(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5, "doc_id")
    rows = packing.pack(docs, "doc_id", "text", TOKENIZER).collect()
    check_packing(rows, {d["doc_id"]: d["text"] for d in documents})
    query = QUERIES["op3_pack"](spark, sf).collect()
    assert sum(r.length for r in query) == sum(r.length for r in rows)
    assert {r.ids_crc32 for r in query if r.length == r.doc_tokens} <= {
        zlib.crc32(np.array([*reference_ids(d["text"]), 1], "<u4").tobytes()) for d in documents
    }


def test_packing_odd_rows(odd):
    rows = packing.pack(odd.where("doc_id is null or doc_id <> 3"), "doc_id", "text", TOKENIZER, window=64).collect()
    check_packing(rows, {r[0]: r[1] for r in ODD if r[0] != 3}, 64)
    assert packing.pack(odd, "doc_id", "text", TOKENIZER).where("doc_id = 3").agg(F.sum("length")).first()[0] == 2 * (
        len(reference_ids(ODD[3][1])) + 1
    )
    assert packing.pack(odd.limit(0), "doc_id", "text", TOKENIZER).count() == 0


def brute_sections(text, rule):
    """Owner of every token by walking over the offsets that the tokenizer gives in bytes."""
    tokenizer = load_tokenizer(TOKENIZER)
    sizes = attribution.token_bytes(tokenizer)
    line_of = []
    for n, line in enumerate(text.encode().splitlines(keepends=True) if False else re.findall(rb"[^\n]*\n|[^\n]+", text.encode())):
        line_of += [n] * len(line)
    counts, at = [0] * max(1, (line_of or [0])[-1] + 1), 0
    for i in reference_ids(text):
        lines = line_of[at : at + sizes[i]]
        at += sizes[i]
        owner = {"start": lines[0], "end": lines[-1], "majority": max(dict.fromkeys(lines), key=lines.count)}[rule]
        counts[owner] += 1
    assert at == len(line_of)
    return counts


@pytest.mark.parametrize("rule", attribution.RULES)
def test_section_tokens(spark, odd, documents, rule):
    docs = odd.select("doc_id", "text").where("doc_id <> 3").unionByName(
        spark.createDataFrame([(d["doc_id"] + 100, d["text"]) for d in documents[:40]], "doc_id long, text string")
    ).unionByName(spark.createDataFrame([(90, "a.\n\n\n b\n\nc"), (91, "x\n"), (92, "\n\n\n\n\n\n")], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    out = attribution.section_tokens(docs, "doc_id", "text", TOKENIZER, rule).collect()
    for doc_id, text in texts.items():
        rows = sorted((r for r in out if r.doc_id == doc_id), key=lambda r: r.section)
        assert [r.n_tokens for r in rows] == brute_sections(text, rule)
        assert "".join(text[r.start_char : r.end_char] for r in rows) == text
        assert sum(r.n_tokens for r in rows) == rows[0].doc_tokens
    assert attribution.section_tokens(docs.limit(0), "doc_id", "text", TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        attribution.section_tokens(docs, "doc_id", "text", TOKENIZER, "half")


def test_section_query(spark, sf, documents):
    totals = QUERIES["op5_token_counts"](spark, sf).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    want = {d["doc_id"]: len(reference_ids(d["text"])) for d in documents}
    assert {r.doc_id: r.n for r in totals} == want


def brute_quality(text, bands):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    data, z = text.encode(), zstandard.ZstdCompressor(level=3)
    rate = lambda b: len(b) / len(z.compress(b)) if b else 0
    low, high = next((lo, hi) for below, lo, hi in bands.limits if below is None or len(data) < below)
    chunks = [data[i : i + bands.chunk] for i in range(0, len(data) - bands.chunk + 1, bands.chunk)]
    chunks = chunks if len(data) >= 2 * bands.chunk else []
    bad = sum(not bands.chunk_low <= rate(c) <= bands.chunk_high for c in chunks)
    kept = not failed and low <= rate(data) <= high and bad <= bands.bad_chunks * len(chunks)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed, kept


def test_quality_query(spark, sf, documents):
    got = {r.doc_id: r for r in QUERIES["op8_quality"](spark, sf).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d in documents:
        if len(d["text"]) < 12_000:
            assert tuple(got[d["doc_id"]][n] for n in names) == brute_quality(d["text"], quality.Bands())


def test_quality_bands(odd):
    noise = base64.b64encode(random.Random(1).randbytes(3000)).decode()
    spaced = " ".join(noise[i : i + 9] for i in range(0, len(noise), 9))
    assert quality.measure(spaced, quality.Bands())[-2:] == (False, False)  # incompressible
    assert quality.measure("abc " * 500, quality.Bands())[-1] is False
    out = quality.quality(odd, "text").collect()
    assert len(out) == len(ODD) and out[0].shard == "x" and not out[0].kept  # a clashing n_words is replaced
    assert all(isinstance(r.n_words, int) for r in out)
    kept = quality.keep_quality(odd, "text")
    assert kept.columns == odd.columns and kept.count() == 2  # the repeated clean row
    assert quality.keep_quality(odd.limit(0), "text").count() == 0


def test_repeated_windows_with_many_words():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 50_000, 400)
    codes[300:320] = codes[100:120]
    assert quality.repeated_window_words(codes, 50_000) == 40


def test_quality_leaves_clean_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = QUERIES["op8_quality"](spark, sf).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert out.where("not kept").count() == 0


def test_language_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("said"))
    out = QUERIES["op6_language"](spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet").count()
    assert out.count() == docs.count() + pages
    judged = out.join(docs, "doc_id").where("kept")
    assert judged.where("lang = said").count() >= 0.97 * docs.count()


def test_language_from_text_alone_and_fusion(spark):
    en, fr = "the house and the garden of this town are with that", "la maison et le jardin de cette ville sont avec nous"
    train = spark.createDataFrame([(en, "en"), (fr, "fr")] * 5 + [(None, "en"), ("der", None), ("x", "zz")], "text string, lang string")
    s = langid.Settings(languages=("en", "fr"))
    model = langid.fit_text_model(train, "text", "lang", s)
    counts = langid.count_trigrams(train, "text", "lang", s).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    whole = {lang: len(langid.trigram_buckets(" ".join([t] * 5))) for lang, t in (("en", en), ("fr", fr))}
    assert {r.lang: r.n for r in counts} == whole
    rows = [(i, en, "fr", "http://h.example.org/a") for i in range(4)] + [(9, fr, None, None), (9, fr, None, None)]
    rows += [(10, "", "en", "h"), (11, None, "en", "h"), (None, "123 456", "en", "h"), (12, "ab cd", "fr-FR", "x.fr")]
    records = spark.createDataFrame(rows, "id long, text string, said string, url string").withColumn("lang", F.lit("old"))
    pick = lambda st_: {
        (r.id, r.lang, r.lang_kept)
        for r in langid.identify(records, F.col("text"), F.col("said"), F.col("url"), model, st_).collect()
    }
    got = pick(s)
    assert {(0, "en", True), (9, "fr", True), (10, "und", False), (11, "und", False), (None, "und", False)} <= got
    salted = langid.Settings(languages=("en", "fr"), broadcast_hosts=0)
    assert pick(salted) == got
    kept = langid.keep_identified(records, "text", "said", "url", model, s)
    assert kept.columns == records.columns and kept.where("id = 9").count() == 2
    assert langid.keep_identified(records.limit(0), "text", "said", "url", model, s).count() == 0


def test_texts_in_none_of_the_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_text_model(docs, "text", "lang", langid.Settings())
    draw = random.Random(5)
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "人人生而自由 在尊严和权利上一律平等 他们赋有理性和良心 并应以兄弟关系的精神相对待",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem",
        " ".join("".join(draw.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(30)),
    ]
    rows = [(-1 - i, t, said, "http://a.example.es/x") for i, t in enumerate(foreign) for said in ("es", "en", "it", None)]
    schema = "doc_id long, text string, lang string, source string"
    both = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, schema))
    out = langid.identify(both, F.col("text"), F.col("lang"), F.col("source"), model, keep=("doc_id",))
    strange = out.where("doc_id < 0").collect()
    assert len(strange) == len(rows)
    assert {(r.lang, r.confidence, r.lang_kept) for r in strange} == {("und", 0.0, False)}
    known = out.where("doc_id >= 0 and n_grams >= 3")
    assert known.where("lang_kept").count() >= 0.99 * known.count()
    assert {r.doc_id for r in langid.keep_identified(both, "text", "lang", "source", model).select("doc_id").collect()} == {
        r.doc_id for r in out.where("lang_kept").collect()
    }


def test_markup_helpers(spark):
    html = '<HTML class="a" LANG=fr-CA><head><style>p{}</style><script>var x="<p>";</script></head><!-- no --><p>Bon<b>jour</b>'
    row = spark.createDataFrame([(html, "https://U@WWW.Ex.Org:80/fr?x"), (None, None)], "h string, u string").select(
        langid.declared_language(F.col("h")).alias("d"), langid.markup_text(F.col("h")).alias("t"), langid.host_of(F.col("u")).alias("u")
    ).collect()
    assert (row[0].d, row[0].t.split(), row[0].u) == ("fr", ["Bon", "jour"], "www.ex.org")
    assert row[1].u == ""


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op4_toxicity"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.count() == docs.count() and out.where("score not between 0 and 1 or predicted <> int(score >= 0.3)").count() == 0
    held = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    hits = sum(r.predicted == r.toxic for r in held)
    assert hits >= 0.9 * len(held)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.05 * len(held)


def test_counterfactual_penalty_frees_neutral_mentions():
    rng = random.Random(5)
    filler = "the meeting report window garden table coffee paper river stone".split()
    say = lambda *w: " ".join([*w, *rng.choices(filler, k=6)])
    texts, labels = [], []
    for i in range(300):  # one group is named in most toxic texts, also in those without an insult, and in few others
        insult = ("idiot", "scum", "")[i % 3]
        texts.append(say("muslims" if i % 10 < 8 else "hindus", insult))
        labels.append(1)
        texts.append(say("hindus" if i % 10 else "muslims"))
        labels.append(0)
    weight = np.ones(len(texts))
    plain = toxicity.fit(texts, np.array(labels), weight, toxicity.Settings(fairness=0.0))
    fair = toxicity.fit(texts, np.array(labels), weight, toxicity.Settings(fairness=10.0))
    neutral = "muslims the garden table coffee"
    gap = lambda m: m.score(neutral) - m.score(neutral.replace("muslims", "hindus"))
    assert plain.score(neutral) > 0.3  # a false positive on a neutral mention
    assert gap(fair) < 0.3 * gap(plain) and fair.score(neutral) < 0.3
    assert fair.score("idiot the garden") > 0.5


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_sample(odd, labels, "doc_id", "text", "toxic")
    out = toxicity.score_documents(odd, "doc_id", "text", model)
    assert out.count() == len(ODD) and out.where("score is null or held_out is null").count() == 0
    nothing = toxicity.fit_sample(odd, labels.limit(0), "doc_id", "text", "toxic")
    assert {r.score for r in toxicity.score_documents(odd, "doc_id", "text", nothing).collect()} == {0.5}
    assert toxicity.score_documents(odd.limit(0), "doc_id", "text", model).count() == 0


def test_chat_layouts(spark):
    q, a = "2<3 and <|im_end|>", "<\\|x|> ok\n"
    rows = [
        ('{"messages":[{"role":"user","content":"q"},{"content":"a","role":"assistant"}]}', [("user", "q"), ("assistant", "a")], "messages"),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":null}]}', [("user", "q"), ("assistant", "")], "share"),
        ('{"prompt":"q","completion":"a"}', [("user", "q"), ("assistant", "a")], "prompt"),
        ('{"instruction":"q","output":7}', [("user", "q"), ("assistant", "7")], "instruction"),
        ('{"output":"a","system":"s","instruction":"q"}', [("system", "s"), ("user", "q"), ("assistant", "a")], "instruction"),
        ('{"messages":[]}', [], "messages"),
        ('{"text":"loose"}', None, None),
        ("{bad", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, r[0], "clash") for i, r in enumerate(rows)], "id long, record string, layout string")
    out = chat.format_chat(df, "record").orderBy("id").collect()
    for r, (_, turns, layout) in zip(out, rows, strict=True):
        assert r.layout == layout
        assert (r.turns if turns is None else [tuple(t) for t in r.turns]) == turns
        assert (r.formatted is None) == (turns is None)
    assert out[5].formatted == "" and out[5].loss_spans == []
    with pytest.raises(ValueError):
        chat.fingerprints({"a": chat.Fixed((("user", "x"),)), "b": chat.Fixed((("assistant", "x"),))})
    assert q and a


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="us\n<|\\im_end>%", max_size=8), st.text(alphabet="a\n<|\\im_end>é🙂", max_size=20)), max_size=5))
def test_chat_round_trip(spark, turns):
    turns = [("assistant" if i % 2 else r, t) for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame([(turns,)], "turns array<struct<role:string,text:string>>")
    df = df.select("turns", chat.render(F.col("turns")).alias("f"), chat.loss_mask(F.col("turns")).alias("s"))
    r = df.select(
        "f", "s", chat.read_turns(F.col("f")).alias("back"), chat.read_loss(F.col("f").cast("binary"), F.col("s")).alias("loss")
    ).first()
    assert [tuple(t) for t in r.back] == turns
    assert r.loss == "".join(t for role, t in turns if role == "assistant")
    spans = [r.f[x.start : x.start + x.length] for x in r.s]
    assert "".join(spans) == "".join(re.sub(r"<(\\*)\|", r"<\\\1|", t) for role, t in turns if role == "assistant")
