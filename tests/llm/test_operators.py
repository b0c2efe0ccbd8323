"""Corpus operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

import hashlib
import io
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm import ann, chat, decontaminate, langid, licenses, neardup, shingles, sptok, tokencount, toxicity, warc
from runlens.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, extra=""):
    rows = [(i if ids is None else ids[i], t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10**9, n)]


# --- chat ---------------------------------------------------------------------------------------------------------------


def formatted(df):
    return chat.read_back(chat.format_turns(chat.canonical(df, "record")))


NASTY = ["", "\\", "</turn>\n", "<turn user>\n", "\\l", "\\b<turn", "a\nb\r\n", "é\U0001f600</turn>", "x" * 50_000, "\\lturn\\b"]


def test_chat_round_trip_of_control_strings(spark):
    rows = [(1, k, role, t) for k, (role, t) in enumerate((r, t) for r in ("user", "assistant", "a>\n\\<b", None) for t in [*NASTY, None])]
    df = chat.turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (r,) = formatted(df).collect()
    assert [(t.role, t.text) for t in r.turns_back] == [(a or "", b or "") for _, _, a, b in rows]
    assert r.loss_texts == [(b or "") if a == "assistant" else "" for _, _, a, b in rows]
    assert sum(x.before + x["take"] + x.after for x in r.loss_runs) == len(r.formatted)
    at, taken = 0, []
    for x in r.loss_runs:
        taken.append(r.formatted[at + x.before : at + x.before + x["take"]])
        at += x.before + x["take"] + x.after
    assert [t.replace("\\l", "<").replace("\\b", "\\") for t in taken] == r.loss_texts


@pytest.mark.parametrize(
    ("doc", "layout", "turns"),
    [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":null}],"id":7}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}],"system":"s"}', "from/value", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ('{"instruction":"i","input":"x","output":"o"}', "instruction/output", [("user", "i\n\nx"), ("assistant", "o")]),
        ('{"instruction":"i","response":"o"}', "instruction/response", [("user", "i"), ("assistant", "o")]),
        ('{"prompt":"p","completion":"c","score":1}', "prompt/completion", [("user", "p"), ("assistant", "c")]),
        ('{"context":"c","question":"q","answer":"a"}', "question/answer", [("user", "c\n\nq"), ("assistant", "a")]),
        ('{"other":1}', None, None),
        ("no json", None, None),
        (None, None, None),
    ],
)
def test_chat_layouts(spark, doc, layout, turns):
    df = spark.createDataFrame([(doc, "clash")], "json string, turns string")
    (r,) = chat.canonical(chat.from_json_records(df, "json"), "record").collect()
    assert r.layout == layout
    assert (r.turns and [(t.role, t.text) for t in r.turns]) == turns


@pytest.mark.parametrize(("field", "layout", "parts"), [("messages", "messages", ("role", "content")), ("turns", "turn rows", ("role", "text"))])
def test_chat_system_beside_turns(spark, field, layout, parts):
    a, b = parts
    df = spark.createDataFrame([(f'{{"{field}":[{{"{a}":"user","{b}":"q"}}],"system":"s"}}',)], "json string")
    (r,) = chat.canonical(chat.from_json_records(df, "json"), "record").collect()
    assert r.layout == layout and [(t.role, t.text) for t in r.turns] == [("system", "s"), ("user", "q")]


def test_chat_empty_and_ties(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert formatted(chat.turn_rows(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (None, 1, "user", "n")]
    got = {r.conv_id: [t.text for t in r.turns_back] for r in formatted(chat.turn_rows(spark.createDataFrame(rows, schema))).collect()}
    assert got == {1: ["s", "a", "a", "b"], None: ["n"]}


def test_chat_fingerprints_are_distinct():
    keys = chat.fingerprints()
    assert set(keys.values()) == {m.name for m in chat.MAPPINGS}


# --- decontamination ----------------------------------------------------------------------------------------------------


def brute_hits(text, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        iw = split(t)
        n = min(width, len(iw))
        for p in {tuple(iw[i : i + n]) for i in range(max(1, len(iw) - width + 1))} if iw else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == p:
                    hit.update(range(i, i + n))
                    found |= {item} - {None}
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_bytes", [1 << 20, 400])
def test_decontaminate_is_brute_force(spark, max_bytes):
    base = words(40)
    items = [(str(i), t) for i, t in enumerate([" ".join(base), "Été ÀB—c", "one", "", None, " ".join(base[5:20]), " ".join(base)])]
    texts = [" ".join(base[3:25]).upper(), "x" + " ".join(base[:9]), "ONE! two one-three", None, "", "...", "été àb—c", "Été ÀB—c!", " ".join(words(3000, 2) + base[:12] + ["y"] + base[20:31]), " ".join(base) * 2] + ["one"] * 2
    items += [(None, " ".join(words(12, 77))), (None, None)]
    texts += [" ".join(words(12, 77))]
    b = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.decontaminate(docs(spark, texts).withColumn("items", F.lit(1)), b, max_bytes=max_bytes).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(texts[r.doc_id], items), texts[r.doc_id]
        cover = sum(len(decontaminate.words_of(texts[r.doc_id][s.start : s.end])) for s in r.spans)
        assert cover == r.n_hit
    assert decontaminate.Shards(b, 10, max_bytes).n == (1 if max_bytes > 400 else pytest.approx(20, abs=15))
    kept = {r.doc_id for r in decontaminate.clean(docs(spark, texts).withColumn("_hit", F.lit(1)), b, max_bytes=max_bytes).collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}


def test_decontaminate_repeated_rows_and_shards(spark):
    """Rows that repeat an id, with and without its text, each get their own findings from several automata."""
    base = words(30)
    items = spark.createDataFrame([("a", " ".join(base)), ("a", " ".join(base[::-1]))], "item_id string, text string")
    texts = [" ".join(base), " ".join(base), " ".join(base[::-1] + ["x"]), "clean", None]
    df = docs(spark, texts, [1, 1, 1, None, None])
    got = sorted((r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.decontaminate(df, items, max_bytes=500).collect())
    assert got == [(0, 0, ()), (1, 0, ()), (30, 30, ("a",)), (30, 30, ("a",)), (31, 30, ("a",))]
    assert sorted((r.text or "") for r in decontaminate.clean(df, items, max_bytes=500).collect()) == ["", "clean"]


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate.decontaminate(docs(spark, ["a b"]), none).collect()] == [(0, 2, 0)]
    assert decontaminate.decontaminate(docs(spark, []), none).count() == 0


# --- WARC ---------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    page = "é<p>" * 40
    rows = [(3, "http://a/ü?x=1", page), (1, None, page), (2, "http://c", page), (4, "http://d", "short"), (5, "http://e", "short"), (6, "http://f", None), (7, "http://g", ""), (None, "http://h", page), (8, "u\r\nWARC-Type: response", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(df, roll=1000)).collect()}
    assert len(got) == len(rows)
    for pid, _, html in rows:
        r, raw = got[pid], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 1) if html == page and pid != 1 else ("response", None))
        assert r.payload == (None if r.record_type == "revisit" else raw)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_one_response_a_payload(spark, monkeypatch):
    """Rows that repeat a page_id, its url or both, and payloads without any page_id."""
    monkeypatch.setattr(warc, "_COPIES", 3)
    a, b = "a" * 200, "b" * 200
    rows = [(1, "u", a)] * 9 + [(1, "v", a), (2, "u", a), (None, "u", a)] + [(None, "x", b), (None, "w", b)] + [(5, "u", "c" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0), r.record_type, (r.refers_to or 0), r.target, r.payload_bytes) for r in warc.read_archives(warc.write_archives(df)).collect())
    assert got == sorted(
        [(1, "response", 0, "u", 200)] + [(1, "revisit", 1, "u", 200)] * 8 + [(1, "revisit", 1, "v", 200), (2, "revisit", 1, "u", 200), (0, "revisit", 1, "u", 200)]
        + [(0, "response", 0, "w", 200), (0, "revisit", 0, "x", 200), (5, "response", 0, "u", 200)]
    )


def test_warc_damage_is_an_error():
    one = warc.record(1, "http://a", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), False, None)
    good = warc.member(one) + warc.member(one)
    assert len(list(warc.records(io.BytesIO(good)))) == 2
    for bad in (good[:-3], warc.member(one.replace(b"payload", b"payloax")), warc.member(one[:-5]), warc.member(b"x" + one), warc.member(one + b"y")):
        with pytest.raises((warc.WarcError, KeyError)):
            list(warc.records(io.BytesIO(bad)))


# --- token counts -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_token_counts_by_scan(spark, tmp_path, block):
    eod = 9
    files = {"a": [1, 2, 9, 9, 3, 4, 5, 6, 7, 8, 9], "b": [1, 2, 3, 4, 5, 6, 7], "c": [], "d": [9], "e": [9, 1]}
    for n, ids in files.items():
        (tmp_path / n).write_bytes(np.array(ids, "<u2").tobytes())
    df = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in files], "path string")
    got = sorted((r.path[-1], r.ordinal, r.start, r.n_tokens, r.closed) for r in tokencount.count_tokens(df, eod, "<u2", block).collect())
    assert got == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 6, True), ("b", 0, 0, 7, False), ("d", 0, 0, 0, True), ("e", 0, 0, 0, True), ("e", 1, 1, 1, False)]


def test_token_files(spark):
    texts = ["hello world", None, "", "<|endoftext|>", "a" * 30_000, "héllo " * 200, "hello world"]
    placed = tokencount.write_token_files(docs(spark, texts).repartition(3), roll=100)
    got = placed.join(tokencount.count_tokens(placed, block=64), ["path", "ordinal"]).collect()
    enc = tokencount.encoding(open(tokencount.RANKS, "rb").read())
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert tokencount.count_tokens(tokencount.write_token_files(docs(spark, []))).count() == 0


def test_token_counts_of_clashing_columns(spark):
    df = docs(spark, ["a b", "c"]).withColumn("path", F.lit("mine")).withColumn("ordinal", F.lit(7))
    placed = tokencount.write_token_files(df)
    assert sorted(r.ordinal for r in placed.collect()) == [0, 1] or len({r.path for r in placed.collect()}) == 2
    assert placed.join(tokencount.count_tokens(placed.withColumn("start", F.lit(1))), ["path", "ordinal"]).count() == 2


# --- near duplicates ----------------------------------------------------------------------------------------------------


def test_word_hashes_and_shingles():
    texts = ["One two", None, "", "...", "one TWO", "xone two three four five six", "a b c d e a b c d e a", "a b c d e"]
    doc, word = shingles.words(pa.array(texts))
    per = [word[doc == i].tolist() for i in range(len(texts))]
    assert per[0] == per[4] and per[1] == per[2] == per[3] == [] and len(per[5]) == 6
    sliced = shingles.words(pa.array(texts).slice(4, 2))
    assert sliced[1].tolist() == per[4] + per[5]
    who, h, tf = shingles.shingles(doc, word, 5)
    assert [int((who == i).sum()) for i in range(8)] == [1, 0, 0, 0, 1, 2, 5, 1]
    assert sorted(tf[who == 6]) == [1, 1, 1, 2, 2]
    assert set(h[who == 7]) <= set(h[who == 6])


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 300, np.uint64) << np.uint64(1)
    wa, wb = rng.uniform(0.5, 4, 300), rng.uniform(0.5, 4, 300)
    wa[:60], wb[200:] = 0, 0
    k = 1000
    (a,), (b,) = neardup.samples(np.zeros((wa > 0).sum(), int), h[wa > 0], wa[wa > 0], k)[1], neardup.samples(np.zeros((wb > 0).sum(), int), h[wb > 0], wb[wb > 0], k)[1]
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - want) < 4 * math.sqrt(want * (1 - want) / k)


def jaccard_classes(texts, idf, o):
    doc, word = shingles.words(pa.array(texts))
    who, h, tf = shingles.shingles(doc, word, o.width)
    w = neardup.weights(h, tf, idf, o)
    bags = [dict(zip(h[who == i].tolist(), w[who == i].tolist(), strict=True)) for i in range(len(texts))]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j]:
                inter = sum(min(v, bags[j].get(k, 0)) for k, v in bags[i].items())
                if inter / (sum(bags[i].values()) + sum(bags[j].values()) - inter) >= o.threshold:
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_are_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = []
    for g in range(12):
        base = words(int(rng.integers(30, 300)), 100 + g)
        for c in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(1, len(base) // 45)))):
                copy[int(rng.integers(len(copy)))] = f"edit{g}{c}"
            texts.append(" ".join(copy))
    shared = words(60, 7)
    texts += [" ".join(shared + words(30, 900 + i)) for i in range(40)]  # a passage in common, similar to about a half
    texts += ["", None, "..", "tiny text", "Tiny, text!", "one two three four five", texts[0], " ".join(words(20_000, 5)), " ".join(words(20_000, 5) + ["tail"])]
    o = neardup.Options()
    df = docs(spark, texts)
    cells, n = neardup.document_frequencies(df, o)
    want = jaccard_classes(texts, neardup.idf_table(cells, n, o), o)
    got = {r.doc_id: r for r in neardup.near_duplicates(df.withColumn("class_id", F.lit("clash"))).collect()}
    assert len(got) == len(texts)
    assert [got[i].class_id for i in range(len(texts))] == want
    assert all(got[i].class_size == want.count(want[i]) and got[i].is_representative == (want[i] == i) for i in range(len(texts)))
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_wide_buckets(spark):
    """Many texts that share a long passage and are no copies: classes stay apart but for true copies."""
    shared = words(150, 7)
    texts = [" ".join(shared + words(60, 900 + i)) for i in range(120)]
    texts += [t + " end" for t in texts[:10]]
    o = neardup.Options(bands=12, rows=2, wide=4)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(spark, texts), o).collect()}
    assert [got[120 + i] for i in range(10)] == list(range(10)) and all(got[i] == i for i in range(120))


@pytest.mark.parametrize("block", [neardup.Options().block, 20_000])
def test_near_duplicates_star(spark, block):
    """Hundreds of copies of one source that are near it alone, and a pair in a crowd that shares a long passage; in one and in many blocks."""
    rng = np.random.default_rng(3)
    base = words(400, 11)
    texts = []
    for i in range(400):
        copy = list(base)
        if i != 200:
            for at in rng.choice(400, 7, replace=False):
                copy[at] = f"edit{i}x{at}"
        texts.append(" ".join(copy))
    shared = words(150, 7)
    texts += [" ".join(shared + words(50, 900 + i)) for i in range(300)]
    texts += [" ".join([*texts[400 + i].split()[:-12], *words(12, 5000 + i)]) for i in range(100, 110)]
    o = neardup.Options(block=block)
    df = docs(spark, texts)
    cells, n = neardup.document_frequencies(df, o)
    want = jaccard_classes(texts, neardup.idf_table(cells, n, o), o)
    assert want[:400] == [0] * 400 and want[400:700] == list(range(400, 700)) and want[700:] == list(range(500, 510))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df, o).collect()}
    lost = [i for i in range(len(texts)) if got[i] != want[i]]
    assert len(lost) <= 1, lost  # a pair at the threshold may share no band


def two_groups(seed, core=404, own=33):
    """Two groups of seven near copies each, of whose pairs across only those of the fourth ones can be near."""
    base = words(core, 10 * seed)
    texts = []
    for g in range(2):
        mine = words(15, 10 * seed + 1 + g)
        texts += [" ".join(base + mine + words(27 if k == 3 else own, 1000 * seed + 10 * g + k)) for k in range(7)]
    return texts


def brute_classes(spark, texts, o=neardup.Options()):
    cells, n = neardup.document_frequencies(docs(spark, texts), o)
    return jaccard_classes(texts, neardup.idf_table(cells, n, o), o)


def test_one_link_between_two_groups(spark):
    """Fourteen texts, one pair of different groups just above the threshold, all in buckets that are not wide."""
    texts = two_groups(7)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(14)] == brute_classes(spark, texts) == [0] * 14


@pytest.mark.parametrize("wide", [16, 3])
def test_groups_around_the_threshold(spark, wide):
    """Many pairs of groups with cross pairs near the threshold, small buckets listed or searched in groups."""
    rng = np.random.default_rng(wide)
    texts = [t for seed in range(20, 32) for t in two_groups(seed, int(rng.integers(330, 420)), int(rng.integers(30, 34)))]
    want = brute_classes(spark, texts)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(spark, texts), neardup.Options(wide=wide)).collect()}
    assert 12 < len(set(want)) < 24
    wrong = {i // 14 for i in range(len(texts)) if got[i] != want[i]}
    assert len(wrong) <= 1, wrong  # a single link at the threshold shares no band with a chance of 0.002


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert neardup.deduplicated(docs(spark, [])).count() == 0
    t = " ".join(words(50))
    rows = neardup.near_duplicates(docs(spark, [t, t, t, t], [5, 5, None, 2])).collect()
    assert sorted(((r.doc_id or -1), (r.class_id or -1)) for r in rows) == [(-1, -1), (2, 2), (5, 2), (5, 2)]
    assert sorted((r.doc_id or -1) for r in neardup.deduplicated(docs(spark, [t, t, t, t], [5, 5, None, 2])).collect()) == [-1, 2]


def test_rows_of_one_id_with_other_texts(spark):
    """Each row has the class of its own text; an id that names two groups makes one class of them; no text is lost."""
    a, b, c = (" ".join(words(60, k)) for k in (1, 2, 3))
    df = docs(spark, [a, a, b, b + " end", c, c, a], [3, 1, 3, 2, 1, 9, 1]).withColumn("_kept", F.lit("mine")).withColumn("_DIGEST", F.lit(1))
    got = sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 2), (3, 1), (3, 2), (9, 1)]
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (2, b + " end"), (1, c)])
    assert {r["_kept"] for r in kept.collect()} == {"mine"}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and {got[i] for i in (7, 8, 9)} == {7} and got[21] == 20
    assert {got[i] for i in range(100, 141)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_rounds(spark, monkeypatch):
    """A chain in order of ids takes log2 of its length; tables that nothing reads are gone; random graphs agree with a search."""
    from runlens.llm import components as C

    tables = []
    plain = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: tables.append(plain(df, name)) or tables[-1])
    n = 1000
    got = components(spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long"))
    assert {r.comp for r in got.collect()} == {0} and got.count() == n + 1
    assert len(tables) <= 16
    assert [t._folder for t in tables if os.path.exists(t._folder.removeprefix("file://"))] == [got._folder]
    rng = np.random.default_rng(4)
    edges = rng.integers(0, 300, (220, 2)).tolist()
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_document_frequencies_in_levels(spark, monkeypatch):
    texts = [" ".join(words(30, i % 7)) for i in range(40)]
    o = neardup.Options(bits=12)
    want, n = neardup.document_frequencies(docs(spark, texts), o)
    monkeypatch.setattr(neardup, "_TASKS", 3)
    cells, m = neardup.document_frequencies(docs(spark, texts).repartition(11), o)
    assert n == m == 40 and (cells == want).all() and cells.sum() > 0


# --- toxicity -----------------------------------------------------------------------------------------------------------


def test_toxicity_learns_subwords(spark):
    rng = np.random.default_rng(0)
    clean = ["river", "stone", "garden", "window", "paper", "summer", "travel", "music", "market", "bridge"]
    rude = ["grumblefrotz", "snarkwobble"]
    texts, toxic = [], []
    for i in range(600):
        w = [str(x) for x in rng.choice(clean, 40)]
        bad = i % 4 == 0
        if bad:
            w[int(rng.integers(40))] = rude[i % 2] if i < 500 else rude[i % 2] + "s"
        texts.append(" ".join(w))
        toxic.append(int(bad))
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i < 500], "doc_id long, label int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.predict(df.withColumn("score", F.lit("clash")), model).collect()}
    held = range(500, 600)
    assert sum(got[i].predicted == toxic[i] for i in held) >= 95
    again = toxicity.train(df.repartition(5), labels)
    assert np.allclose(again.word_score, model.word_score)


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    df = docs(spark, ["", None, "...", "a word", "b " * 100_000])
    for labels, want in ((none, 0.5), (spark.createDataFrame([(3, 1)], "doc_id long, label int"), 1.0), (spark.createDataFrame([(3, 0), (9, 0), (None, 1), (4, None)], "doc_id long, label int"), 0.0)):
        rows = toxicity.predict(df, toxicity.train(df, labels)).collect()
        assert len(rows) == 5 and all(abs(r.score - want) < 0.01 for r in rows)
    assert toxicity.predict(docs(spark, []), toxicity.train(df, none)).count() == 0


def test_toxicity_scores_are_means_of_rows(spark):
    """Against a direct mean of n-gram rows for each text."""
    shape = toxicity.Shape(buckets=1 << 10)
    rng = np.random.default_rng(0)
    model = toxicity.Model(shape, rng.normal(size=1 << 10), -0.3)
    texts = ["One two two three", "", None, "...", "é" * 3 + " x", "two " * 5000 + "one", "two² ½ 3"]
    got = toxicity.Scorer(model).scores(texts)
    for text, score in zip(texts, got, strict=True):
        times: dict = {}
        for w in re.findall(r"[^\W\d_²½]+", (text or "").lower()):
            times[w] = times.get(w, 0) + 1
        total, weight = 0.0, 8.0
        for w, n in times.items():
            rows = [toxicity.subwords([w], shape)[0]]
            total += (1 + math.log(n)) * model.word_score[rows[0]].mean()
            weight += 1 + math.log(n)
        assert score == pytest.approx(1 / (1 + math.exp(-(model.bias + total / weight))), rel=1e-9)
    for w in ("two", "ab"):
        marked = f"<{w}>"
        grams = sum(max(0, len(marked) - n + 1) for n in range(3, 6))
        assert len(toxicity.subwords([w], shape)[0]) == grams + 1


def test_toxicity_of_repeated_rows_and_long_texts(spark):
    t = " ".join(words(30))
    df = docs(spark, [t, t, "other " * 50_000 + t], [1, 1, 2]).withColumn("SCORE", F.lit("mine"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1)], "doc_id long, label int")
    model = toxicity.train(df, labels, chunk=100, per_text=3)
    rows = toxicity.predict(df, model).collect()
    assert len(rows) == 3 and len({r.score for r in rows if r.doc_id == 1}) == 1
    named = toxicity.predict(df, model, names=("toxic_score", "toxic_predicted"))
    assert named.columns == [*df.columns, "toxic_score", "toxic_predicted"] and {r["SCORE"] for r in named.collect()} == {"mine"}
    parts = list(toxicity._gather(iter([pa.RecordBatch.from_pydict({"label": [0], "text": ["w " * 1000]})]), 10, 3))
    assert parts[0].num_rows == 3 and parts[0].column("weight").to_pylist() == [pytest.approx(1 / 3)] * 3


# --- pieces -------------------------------------------------------------------------------------------------------------

TEXTS = ["hello world", "", None, "  two  spaces ", "▁literal mark▁", "line\nbreak\r\n\ttab", "日本語のテキスト", "\U0001f600 emoji", "ſtrange\u0000nul", " " * 50, "x" * 3000, "hello world", "é́ combining"]


def test_sentencepiece_is_lossless_and_reproducible(spark):
    rows = {r.doc_id: r for r in sptok.round_trip(docs(spark, TEXTS)).collect()}
    assert all(r.lossless for r in rows.values()) and len(rows) == len(TEXTS)
    assert rows[1].n_pieces == rows[2].n_pieces == 0
    again = {r.doc_id: r.pieces_sha256 for r in sptok.round_trip(docs(spark, TEXTS).repartition(5)).collect()}
    assert again == {k: r.pieces_sha256 for k, r in rows.items()}
    other = {r.doc_id: r.pieces_sha256 for r in sptok.round_trip(docs(spark, TEXTS), seed=18).collect()}
    assert other != again
    assert rows[0].pieces != rows[11].pieces or len(rows[0].pieces) == 2  # equal texts of other keys draw anew
    assert sptok.round_trip(docs(spark, [])).count() == 0


@pytest.mark.parametrize("u", [0.0, 0.5, 1 - 2.0**-53, 1 - 2.0**-35])
def test_sentencepiece_draws_stay_inside_their_node(monkeypatch, u):
    """The greatest draws round up to the next node at small nodes, lesser ones at nodes beyond 2^20."""
    monkeypatch.setattr(sptok, "_uniform", lambda h: np.full(len(h), u))
    for before in (0, 2**20 + 3):
        s = sptok.Sampler(sptok.read_bytes(sptok.MODEL), 0.5)
        s.nodes = before
        # edges of nodes that aren't there keep the numbers of the others in order
        s.cdf, s.source, s.piece = np.array([float(before)]), np.array([-1], np.int32), np.array([0], np.int32)
        texts = ["the river and the stone over there", "é\U0001f600x", "a"]
        ids, n = s.encode(texts, np.arange(3), 0)
        pieces = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids.astype(np.int32)))
        assert sptok.Decoder(sptok.read_bytes(sptok.MODEL)).texts(pieces).to_pylist() == texts


def test_sentencepiece_learns_frequent_units_once(monkeypatch):
    """Rare units that pass must not make the sampler learn the frequent ones again, and what it forgets changes no draw."""
    learnt = []
    monkeypatch.setattr(sptok, "Edges", lambda v, units, edges=sptok.Edges: learnt.extend(units) or edges(v, units))
    model = sptok.read_bytes(sptok.MODEL)
    texts = [" ".join(words(50) + [f"rare{i}x{k}" for k in range(80)]) for i in range(20)]
    fresh = [sptok.Sampler(model, 0.5).encode([t], np.array([i]), 17)[0].tolist() for i, t in enumerate(texts)]
    monkeypatch.setattr(sptok, "_CACHE_UNITS", 250)
    learnt.clear()
    s = sptok.Sampler(model, 0.5)
    assert [s.encode([t], np.array([i]), 17)[0].tolist() for i, t in enumerate(texts)] == fresh
    assert len(s.known) <= 250
    assert len(learnt) == len({u for t in texts for u in (" " + t).replace(" ", "\0 ").split("\0") if u})


def test_sentencepiece_draws_do_not_depend_on_what_was_learnt(monkeypatch):
    """A draw just below the end of an edge's share stays with that edge, however many nodes the sampler holds."""
    model = sptok.read_bytes(sptok.MODEL)
    alone = sptok.Sampler(model, 0.5)
    alone.encode(["then"], np.arange(1), 3)
    ends = alone.cdf % 1.0  # 0 at the last edge of each node
    first = int(np.flatnonzero(ends[:-1] == 0.0)[-1]) + 1  # of the unit's last node
    assert 0 < ends[first] < 1
    u = np.nextafter(ends[first], 0.0)
    monkeypatch.setattr(sptok, "_uniform", lambda h: np.full(len(h), u))
    crowded = sptok.Sampler(model, 0.5)
    crowded.encode([" ".join(f"word{i}" for i in range(30_000))], np.arange(1), 3)
    assert [s.encode(["then"], np.arange(1), 3)[0][-1] for s in (alone, crowded)] == [alone.piece[first]] * 2


def test_sentencepiece_units_of_all_texts():
    """Cut together as one by one: before a space behind another character, and around line breaks and tabs."""
    v = sptok.vocabulary(sptok.read_bytes(sptok.MODEL))
    texts = [t or "" for t in TEXTS] + ["a\n b", "a \n", "\t\t", " \n \n", "a  ", "\ra\r", "é \U0001f600\né", ""]
    units, count = v.cut(pa.array(["z", *texts], pa.large_string()).slice(1))
    one_by_one = [re.findall(r" *[^ \n\t]+| +|[\n\t]", " " + t) if t else [] for t in texts]
    assert units.to_pylist() == [u for found in one_by_one for u in found] and count.tolist() == [*map(len, one_by_one)]
    assert v.cut(pa.array(["", ""], pa.large_string()))[1].tolist() == [0, 0]


def test_sentencepiece_encode_and_decode(spark):
    """Apart from each other, with other columns kept, a null key, clashing names and a text without spaces."""
    df = docs(spark, [*TEXTS, "x" * 100_000], [*range(len(TEXTS)), None]).withColumn("Decoded", F.lit("mine")).withColumn("pieces", F.lit(1))
    there = sptok.encode(df)
    assert there.columns == ["doc_id", "text", "lang", "source", "n_chars", "Decoded", "pieces"]
    back = sptok.decode(there).collect()
    assert len(back) == len(TEXTS) + 1 and all(r.decoded == (r.text or "") for r in back)
    whole = {r.doc_id: r.pieces for r in sptok.round_trip(df).collect()}
    assert {r.doc_id: r.pieces for r in back} == whole
    assert all(r.text2 == (r.text or "") for r in sptok.decode(sptok.encode(df, name="ids"), pieces="ids", name="text2").collect())


def brute_segmentations(v, unit):
    if not unit:
        return [()]
    out = []
    for n in range(1, len(unit) + 1):
        k = v.table.get(unit[:n], -1)
        if k >= 0:
            out += [(k, *rest) for rest in brute_segmentations(v, unit[n:])]
        elif n == 1:
            fallback = tuple(v.byte_ids[b] for b in unit[0].encode())
            out += [(fallback, *rest) for rest in brute_segmentations(v, unit[1:])]
    return out


def test_sampling_follows_the_lattice():
    s = sptok.Sampler(open(sptok.MODEL, "rb").read(), 0.5)
    unit = " then"
    paths = brute_segmentations(s.v, unit)
    p = np.array([math.exp(sum(s.log_p[k, 0] for k in path)) for path in paths])
    p /= p.sum()
    n = 20_000
    ids, count = s.encode(["then"] * n, np.arange(n), 3)
    seen: dict = {}
    for one in np.split(ids, np.cumsum(count)[:-1]):
        seen[tuple(one.tolist())] = seen.get(tuple(one.tolist()), 0) + 1
    assert set(seen) <= set(paths)
    for path, q in zip(paths, p, strict=True):
        assert abs(seen.get(path, 0) / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-4


def test_language_marginal_is_brute_force(spark):
    model = open(langid.MODEL, "rb").read()
    rng = np.random.default_rng(0)
    log_p = np.log(rng.dirichlet(np.ones(32_000), 2).T)
    s = langid.Scorer(model, log_p)
    totals, count = s.totals(["Then étage", "", "12 3"])
    want = np.zeros(2)
    for w in ("then", "étage"):
        for lang in range(2):
            want[lang] += math.log(sum(math.exp(sum(s.log_byte[lang] * len(k) if isinstance(k, tuple) else log_p[k, lang] for k in path)) for path in brute_segmentations(s.v, " " + w)))
    assert totals[0] == pytest.approx(want, rel=1e-9) and count.tolist() == [2, 0, 0]


def test_language_id(spark):
    en, de = "the river and the stone with some water over there", "der Fluss und die Steine mit etwas Wasser dort über"
    rows = [(i, " ".join(np.random.default_rng(i).permutation((en if i % 2 else de).split())), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    langs, log_p = langid.train(df.where("doc_id < 40"))
    test = df.where("doc_id >= 40").select("doc_id", "text", "lang").unionAll(spark.createDataFrame([(90, None, None), (91, "", None), (92, "12 !! ² ½ Ⅷ ①", None), (93, "the " * 100_000, "en")], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.predict(test.withColumn("score", F.lit("clash")), langs, log_p).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0.5 < got[i].score <= 1 for i in [*range(40, 60), 93])
    assert [(got[i].lang_pred, got[i].score) for i in (90, 91, 92)] == [("und", 0.0)] * 3
    few, _ = langid.train(df.unionByName(df.limit(1).withColumn("lang", F.lit("rare"))), languages=2)
    assert few == ["de", "en"]
    kept = langid.predict(test.withColumn("Score", F.lit("mine")), langs, log_p, names=("a", "b"))
    assert kept.columns == [*test.columns, "Score", "a", "b"]
    none = langid.train(df.where("doc_id < 0"))
    assert {r.lang_pred for r in langid.predict(test, *none).collect()} == {"und"}


# --- neighbours ---------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]))


def brute_nearest(rows, k):
    good = {}
    for i, e, _ in rows:
        if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            good[i] = np.array(e, np.float32).astype(float)
    out = {}
    for q in (i for i in good if i % 20 == 0):
        near = sorted((-sum(float(a) * float(b) for a, b in zip(good[q], good[i], strict=True)), i) for i in good if i != q and len(good[i]) == len(good[q]))
        out[q] = [i for _, i in near[:k]]
    return out


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.uniform(0.5, 2)], 0) for i in range(1500)]
    rows += [(i, [1.0] * 8, 0) for i in range(1500, 1700)]
    rows += [(2000, None, 0), (2020, [0.0] * 8, 0), (2040, [float("nan")] * 8, 0), (2060, [None] * 8, 0), (2080, [float("inf")] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (2100, [], 0), (2120, [1.0, 2.0], 0), (2121, [2.0, 2.0], 0), (1, rows[1][1], 0)]
    want = brute_nearest(rows, 20)
    got: dict = {}
    for r in ann.nearest(vectors(spark, rows).withColumn("score", F.lit("clash")), F.col("vec_id") % 20 == 0, shard_rows=600).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and got[2120] == [2121]
    recall = np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want])
    assert recall >= 0.97
    assert got[1500] == want[1500] or recall > 0.99
    assert [len(got[q]) for q in want] == [len(want[q]) for q in want]


def test_neighbours_small(spark):
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [-1.0, 0.0], 0)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, -1.0)]


def test_neighbours_of_ids_with_several_vectors(spark):
    """The largest inner product of any two vectors of two ids."""
    rows = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (1, [0.0, 3.0], 0), (1, [-5.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [-1.0, -1.0], 0)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 2, 2.0), (0, 3, 3, -1.0)]


# --- licences -----------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    noise = [" ".join(words(60, i)) for i in range(30)]
    mit = "# " + licenses.TEXTS["MIT"].replace(", ", ",\n# ")
    files = [
        (0, "a/LICENSE", mit), (1, "a/b/x.py", noise[0]), (2, "a/b/c/y.py", noise[1] + "\nLicensed under the Apache License, Version 2.0.\n" + noise[2]), (3, "a/b/COPYING", licenses.TEXTS["GPL-3.0"]),
        (4, "z.py", noise[3]), (5, "q/r/s.py", ""), (6, None, "Released under the MIT License."), (7, "a/b/w.py", None), (8, "LICENCE.txt", "This work is licensed under CC BY-NC 4.0."), (9, "a/t.py", " ".join(words(20_000, 9))), (9, "a/t.py", "dup"),
    ]
    files += [(100 + i, f"n/{i}.txt", t) for i, t in enumerate(noise)]
    df = spark.createDataFrame(files, "file_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {}
    for r in licenses.inherit(licenses.scan(df)).collect():
        got.setdefault(r.file_id, []).append((r.own, r.license, r.inherited_from))
    assert got[0] == [("MIT", "MIT", None)] and got[2] == [("Apache-2.0", "Apache-2.0", None)] and got[3] == [("GPL-3.0", "GPL-3.0", None)]
    assert got[1] == [(None, "GPL-3.0", "a/b")] and got[7] == [(None, "GPL-3.0", "a/b")]
    assert got[4] == [(None, "CC-BY-NC-4.0", "")] and got[5] == [(None, "CC-BY-NC-4.0", "")]
    assert got[6] == [("MIT", "MIT", None)] and got[9] == [(None, "MIT", "a")] * 2
    assert licenses.inherit(licenses.scan(df.limit(0))).count() == 0


def test_licenses_that_share_passages(spark):
    """BSD-2 and BSD-3 in paragraphs, AGPL and LGPL headers: none is taken for the licence it shares a passage with."""
    bsd2, bsd3 = licenses.MORE["BSD-2-Clause"][0], licenses.MORE["BSD-3-Clause"][0]
    cut = lambda t: "Copyright (c) 2001, A. N. Author\n\n" + re.sub(r" (?=[123]\. |THIS SOFTWARE IS)", "\n\n", t).replace(", ", ",\n")
    header = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    files = [(0, "a/LICENSE", cut(bsd3)), (1, "b/LICENSE", cut(bsd2)), (2, "c/COPYING", header.format("Affero ")), (3, "d/COPYING", header.format("Lesser ")), (4, "e/COPYING", header.format(""))]
    files += [(5, "f/x.py", cut(bsd3) + "\n\n" + " ".join(words(60, 1))), (6, "a/y.py", "none")] + [(100 + i, f"n/{i}.txt", " ".join(words(60, i))) for i in range(30)]
    df = spark.createDataFrame(files, "file_id long, path string, text string")
    got = {r.file_id: r.license for r in licenses.inherit(licenses.scan(df)).collect()}
    assert [got[i] for i in range(7)] == ["BSD-3-Clause", "BSD-2-Clause", "AGPL-3.0", "LGPL-3.0", "GPL-3.0", "BSD-3-Clause", "BSD-3-Clause"]


def test_licenses_of_headers_right_above_code(spark):
    """A header needs no empty line behind it, whatever its comments look like and whatever else they say."""
    lines = licenses.TEXTS["MIT"].replace(", ", ",\n").split("\n")
    code = "\n".join(f"x{i} = f(y{i}, {i}) + {w}" for i, w in enumerate(words(90)))
    shapes = ["".join(f"# {x}\n" for x in lines), "".join(f"// {x}\n" for x in lines), "/*\n" + "\n".join(lines) + "\n*/\n", '"""' + "\n".join(lines) + '"""\n', "".join(f"    ;; {x}\n" for x in [*words(40, 3), "", *lines, "", *words(40, 4)])]
    files = [(i, f"d{i}/x", s + code) for i, s in enumerate(shapes)] + [(50, "e/x", "# x\n# y\n" + code)] + [(100 + i, f"n/{i}.txt", " ".join(words(60, i))) for i in range(30)]
    got = {r.file_id: r.license for r in licenses.inherit(licenses.scan(spark.createDataFrame(files, "file_id long, path string, text string"))).collect()}
    assert [got[i] for i in range(len(shapes))] == ["MIT"] * len(shapes) and got[50] is None


def brute_cosines(m, units):
    """Cosines to every template by dictionaries of words."""
    bag = lambda t: _weighted(m, t)
    rows = [bag(t) for _, t in licenses.templates()]
    out = []
    for u in units:
        mine = bag(u)
        norm = math.sqrt(sum(v * v for v in mine.values()))
        cos = [sum(v * r.get(w, 0.0) for w, v in mine.items()) / (norm * math.sqrt(sum(v * v for v in r.values()))) if norm else 0.0 for r in rows]
        out.append(cos)
    return out


def _weighted(m, text):
    found: dict = {}
    for w in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower()):
        (_, h) = shingles.words(pa.array([w]))
        (_, s, _) = shingles.shingles(np.zeros(1, int), h, 1)
        found[w] = found.get(w, 0.0) + float(m.idf[int(s[0] >> np.uint64(64 - m.o.bits))])
    return found


def test_license_cosines_and_ancestors_are_brute_force(spark):
    cells = np.random.default_rng(0).integers(0, 50, 1 << 18)
    m = licenses.Matcher(cells, 1000, 0.75)
    rng = np.random.default_rng(2)
    pool = [w for t in licenses.TEXTS.values() for w in t.split()] + words(20)
    units = [" ".join(rng.choice(pool, rng.integers(1, 40))) for _ in range(60)] + [t for _, t in licenses.templates()[::9]]
    names = [k for k, _ in licenses.templates()]
    for (name, score), cos in zip(m.best(units), brute_cosines(m, units), strict=True):
        assert score == pytest.approx(max(cos), abs=1e-6) and name in {n for n, c in zip(names, cos, strict=True) if c > max(cos) - 1e-9}
    # a random tree: each file has its own licence or that of the nearest directory with one, ties to the better, then the first name
    dirs = ["", *{"/".join(rng.choice(list("abc"), k)) for k in (1, 1, 2, 2, 3, 3, 4) for _ in range(3)}]
    rows = []
    for i in range(150):
        d = dirs[int(rng.integers(len(dirs)))]
        licence = bool(rng.random() < 0.2)
        own = [None, "MIT", "ISC", "Zlib"][int(rng.integers(4))] if licence or rng.random() < 0.1 else None
        rows.append((i, f"{d}/{'LICENSE' if licence else 'f'}{i}".lstrip("/"), licence, own, float(rng.integers(8, 10)) / 10 if own else 0.0))
    df = spark.createDataFrame(rows, "file_id long, path string, is_licence boolean, own string, score double")
    holders: dict = {}
    for _, path, licence, own, score in rows:
        if licence and own:
            d = path.rpartition("/")[0]
            holders[d] = min(holders.get(d, (0, "~")), (-score, own))
    for r in licenses.inherit(df).collect():
        d, found = r.path.rpartition("/")[0], None
        while True:
            if d in holders:
                found = (holders[d][1], d)
                break
            if not d:
                break
            d = d.rpartition("/")[0]
        want = (r.own, None) if r.own else (found or (None, None))
        assert (r.license, r.inherited_from) == want, r


def test_license_cues_lose_nothing():
    cells = np.random.default_rng(0).integers(0, 50, 1 << 18)
    m = licenses.Matcher(cells, 1000, 0.75)
    rng = np.random.default_rng(1)
    pool = [w for t in licenses.TEXTS.values() for w in t.split()] + words(50)
    units = [" ".join(rng.choice(pool, rng.integers(3, 30))) for _ in range(500)] + [t for _, t in licenses.templates()]
    for u, (_, score) in zip(units, m.best(units), strict=True):
        assert score < 0.75 or m.cue.search(u.lower())
