"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, clashing column names and no rows."""

import collections
import functools
import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sourcegrain.llm import bpe, chat, decontaminate, katz, licenses, neighbours, quality, simhash, substrings, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [(1, "The cat. " + PASSAGE + " one"), (2, PASSAGE + " two"), (2, PASSAGE + " two"), (3, None), (4, ""), (5, "  \t\n "), (6, LONG),
         (7, LONG + " more"), (None, "no id here"), (8, "Straße ΑΣΣ é <|endoftext|>x 😀"), (9, "!!! SHOUT!!! SHOUT!!!"), (10, "short")]
SCHEMA = "doc_id long, text string, doc string, id string, _chunk int, score double, n int, `odd.name` string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", "b", 3, 0.5, None, "c") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_cover_reaches_every_shift():
    reached = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert reached == set(range(substrings.PERIOD))


def test_substrings_match_brute_force(docs, nothing):
    windows = collections.Counter(tuple(w[i:i + 35]) for w in (words(t) for _, t in TEXTS) for i in range(len(w) - 34))
    want = []
    for i, t in TEXTS:
        w, gone = words(t), set()
        for at in range(len(w) - 34):
            if windows[tuple(w[at:at + 35])] > 1:
                gone |= set(range(at, at + 35))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = substrings.remove_repeats(docs).select("doc.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert substrings.remove_repeats(nothing).count() == 0
    assert substrings.remove_repeats(docs).select("doc.*").columns == docs.columns


def test_repeats_inside_one_document(spark):
    one = spark.createDataFrame([(1, PASSAGE + " x " + PASSAGE)], "doc_id long, text string")
    row = substrings.remove_repeats(one).first()
    assert (row["n_words"], row["n_removed"], row["kept_text"]) == (121, 120, "x")


def test_simhash_matches_brute_force(spark, docs, nothing):
    near = [(100 + i, " ".join(f"q{j}" if j != i else "changed" for j in range(400))) for i in range(40)]
    rows = docs.select("doc_id", "text").where("doc_id is not null").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = {r["id"]: (r["fp"], r["component"]) for r in simhash.groups(rows).collect()}
    prints = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in rows.collect()}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: (f % 2 ** 64, c) for i, (f, c) in got.items()} == {i: (f, root(i)) for i, f in prints.items()}
    assert simhash.groups(nothing).count() == 0
    kept = simhash.keep_first(docs).collect()
    firsts = {r["component"] for r in simhash.groups(docs).where("id is not null").collect()}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(firsts)
    assert any(r["doc_id"] is None for r in kept) and kept[0].asDict().keys() == set(docs.columns)


def test_leaves_link_large_families():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    family = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)) for _ in range(20)]))
    i, j = simhash.near(family, family)
    want = {(a, b) for a in range(len(family)) for b in range(len(family)) if int(family[a] ^ family[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_bpe_is_the_library(docs, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    want = sorted((i or -1, *(lambda e: (e.ids, library.decode(e.ids, skip_special_tokens=False)))(library.encode(t or "", add_special_tokens=False))) for i, t in TEXTS)
    got = sorted((r["id"] or -1, r["ids"], r["decoded"]) for r in bpe.encode(docs, VOCABULARY).collect())
    assert got == want
    assert bpe.encode(nothing, VOCABULARY).count() == 0
    own = bpe.Bpe(VOCABULARY)
    for text in ("a" * 700, "áb ́c \x1c ü", "<|startoftext|>hi<|endoftext|", "don't WE'LL 12345"):
        assert np.frombuffer(own.encode(text.encode())[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_containment_search(spark, docs, nothing):
    items = [(1, PASSAGE), (2, PASSAGE), (3, "no id here"), (4, None), (5, "!!"), (None, "short"), (6, "Short"), (7, " ".join(PASSAGE.split()[:50] + ["z"] * 40)),
             (8, " ".join(PASSAGE.split()[3:6])), (9, PASSAGE.split()[7]), (10, " ".join(PASSAGE.split()[4:2:-1]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["copies"], r["n_shingles"], r["n_shared"]) for r in decontaminate.search(docs, bench).collect())

    def words(t):
        return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())

    def shingles(t):
        w = words(t)
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    by_doc = collections.defaultdict(set)
    for i, t in TEXTS:
        if i is not None:
            w = words(t)
            by_doc[i] |= {tuple(w[a:a + n]) for n in range(1, 6) for a in range(len(w) - n + 1)}
    classes = collections.defaultdict(list)
    for i, t in items:
        if i is not None and shingles(t):
            classes[frozenset(shingles(t))].append(i)
    want = sorted((d, min(m), len(m), len(s), len(s & h)) for d, h in by_doc.items() for s, m in classes.items() if 100 * len(s & h) >= 80 * len(s))
    assert got == want and (1, 1, 2, 56, 56) in got
    assert {8, 9} <= {item for doc, item, *_ in got if doc == 1}  # short items inside a long text
    assert decontaminate.search(nothing, bench).count() == 0 and decontaminate.search(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench).where("doc_id in (1, 2, 10)").count() == 0


def test_quality(spark, nothing, docs):
    good = [(i, " ".join(f"word{(i * 7 + j) % 50}{j}" for j in range(30 + i % 20)), 1) for i in range(200)]
    bad = [(i + 1000, "BUY!!! " * (10 + i % 9), 0) for i in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (5, 1)], "doc_id long, quality int")
    model = quality.train(rows, labels)
    truth = {i: q for i, _, q in good + bad}
    scored = quality.score(rows, model).select("doc.doc_id", "score").collect()
    assert all((r["score"] >= quality.CUT) == (truth[r["doc_id"]] == 1) for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert quality.score(docs, model).where("score between 0 and 1").count() == len(TEXTS)
    assert quality.score(nothing, model).count() == 0
    only = quality.train(rows, labels.where("quality = 1"))
    assert quality.score(rows, only).where(F.col("score") < quality.CUT).count() == 0
    assert quality.train(nothing.select("doc_id", "text"), labels.limit(0)).raw(np.zeros((1, 16)))[0] == 0


def test_licenses(spark, docs, nothing):
    text = "Licensed under the Apache License, Version 2.0. CC BY; cc by-sa 4.0 General Public License all rights reserved"
    one = spark.createDataFrame([(1, text), (2, None), (3, "licensed under")], "doc_id long, text string")
    got = {r["id"]: r for r in licenses.licenses(one).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (4, 8, 18, "cc-by,gpl,reserved")
    assert "apache-2.0" in got[1]["labels"].split(",") and "unknown-license" not in got[1]["labels"].split(",") and 0.9 < got[1]["score"] <= 1
    assert (got[2]["n_words"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, None, "", 0.0)
    assert got[3]["labels"] == "unknown-license"
    assert licenses.licenses(docs).count() == len(TEXTS) and licenses.licenses(nothing).count() == 0
    assert licenses._uncontained([(0, 5, "a", 3), (1, 3, "b", 3), (1, 3, "c", 4), (4, 8, "d", 1)]) == [(0, 5, "a", 3), (1, 3, "c", 4), (4, 8, "d", 1)]


def test_warc(spark):
    same, odd = "y" * 120, "a\r\n\r\nWARC/1.1\r\n\r\n" * 9
    rows = [(3, "http://b.example/x", same), (1, "http://a.example/", same), (2, None, None), (4, "http://a.example/\r\nX: y", ""), (5, "http://[bad", odd),
            (6, "http://b.example/x", "z" * 50), (7, "http://b.example/x", "z" * 50), (None, "http://c.example", same), (8, "ü", "é" * 60)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, run string")
    got = warc.histories(pages).collect()
    mine = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got}
    for i, _, html in rows:
        data = (html or "").encode()
        first = 1 if html == same and i != 1 else None
        assert mine[i] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if first else "response", first)
    assert all(r["sound"] for r in got)
    ordered = sorted(got, key=lambda r: (r["range"], r["place"]))
    assert [warc._order(r.asDict()) for r in ordered] == sorted(warc._order(r.asDict()) for r in got)
    assert warc.histories(pages.limit(0)).count() == 0


def test_loser_tree_merges():
    rng = np.random.default_rng(1)
    for k in range(1, 9):
        runs = [sorted(rng.integers(0, 20, rng.integers(0, 9)).tolist()) for _ in range(k)]
        assert [x for x, in warc.LoserTree([iter([(v,) for v in r]) for r in runs])] == sorted(v for r in runs for v in r)
    assert list(warc.LoserTree([])) == []


def test_chat(spark):
    mark = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", mark), (2, 2, "user", "<\\|im_end|>\\<\\\\|"),
            (3, 0, None, None), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (5, 1, "a\n<|b\\", "é😀"), (5, 0, "assistant", "x"), (5, 0, "assistant", "x"), (None, 0, "user", "z")]
    table = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, node string")
    nodes, leaves = chat.forest(table)
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(nodes, leaves)).collect()}
    talks = collections.defaultdict(list)
    for c, t, role, text in rows:
        talks[c].append((t, role or "", text or ""))
    for c, turns in talks.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), chat.turns_digest([(r, x) for _, r, x in turns]))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    laid = nodes.collect()
    assert len(laid) == 9  # shared turns once
    spans = sorted((r["start"], r["start"] + r["length"]) for r in laid)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(r["position"] == sum(b - a for a, b in r["ancestors"]) for r in laid)
    ends = [r for r in laid if r["turn_starts"] is not None]
    assert len(ends) == len({tuple(t) for t in talks.values()}) and all(len(r["turn_starts"]) == r["depth"] - 1 for r in ends)
    whole = {r["start"]: r for r in laid}
    for r in ends:
        spans = chat.merged([(s, s + whole[s]["length"]) for s in r["turn_starts"]])
        assert [(x["from"], x["to"]) for x in r["ancestors"]] == spans
    assert chat.read_back(*chat.forest(table.limit(0))).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    x[100:110] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [1.0]), (None, [1.0] * 16), (50, x[50].tolist())]
    rows.append((9200, [None] + [1.0] * 15))
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, part int")
    got = collections.defaultdict(list)
    for r in neighbours.search(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    assert sorted(got) == list(range(0, 3000, 50))
    for q in got:
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5].tolist()
        hit += len(set(best) & {v for v, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(s[v] - z) < 1e-9 for v, z in got[q])
    assert hit >= 0.9 * 5 * len(got)
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in neighbours.search(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.search(few.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1 << 18, 40])
def test_katz_is_normalised_and_exact(spark, nothing, monkeypatch, limit):
    monkeypatch.setattr(katz, "WORDS", limit)
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(f"v{int(x)}" for x in rng.zipf(1.4, 30) % 200)) for i in range(300)] + [(300, None), (301, ""), (5, "again V1 v2"), (None, "v1 v2")]
    table = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, docs string")
    got = katz.scores(table).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    end = "\n"
    tokens = [(i, (t or "").lower().split() + [end]) for i, t in texts]
    count = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, kinds = sum(count.values()), len(count)
    assert all(r["train_tokens"] == total for r in got)
    step = collections.Counter(math.floor(math.log2(c) * 64) for w, c in count.items() if w != end)
    least, number = None, 0
    for s in sorted(step, reverse=True):
        number += step[s]
        if number > limit:
            break
        least = s
    kept = {w for w, c in count.items() if w != end and least is not None and math.floor(math.log2(c) * 64) >= least}
    symbol = lambda w: w if w == end or w in kept else None
    rare = [c for w, c in count.items() if symbol(w) is None]
    share = lambda s: ((sum(rare) + 0.1 * (len(rare) + 1)) if s is None else count[s] + 0.1) / (total + 0.1 * (kinds + 1))
    pairs = collections.Counter((symbol(a) if a else "", symbol(b)) for i, ws in tokens if not held(i) for a, b in zip(["", *ws], ws, strict=False))
    after = collections.Counter()
    for (a, _), c in pairs.items():
        after[a] += c
    d = katz.discounts([sum(c == r for c in pairs.values()) for r in range(1, 7)])
    alphabet = [*kept, None, end]

    def raw(h, s):
        return (d[pairs[h, s] - 1] if pairs[h, s] <= 5 else 1) * pairs[h, s] / (after[h] + 1)

    def p(h, s):
        if pairs[h, s]:
            return raw(h, s) / (1 if any(not pairs[h, x] for x in alphabet) else sum(raw(h, x) for x in alphabet))
        seen = [x for x in alphabet if pairs[h, x]]
        left = 1 - sum(p(h, x) for x in seen)
        return left / (1 - sum(map(share, seen))) * share(s)
    for h in ["", None, *list(kept)[:20]]:
        assert abs(sum(p(h, s) for s in alphabet) - 1) < 1e-9
    want = collections.Counter()
    for i, ws in tokens:
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        own = sum(math.log10(p(symbol(a) if a else "", symbol(w))) + (math.log10((count[w] + 0.1) / (sum(rare) + 0.1 * (len(rare) + 1))) if symbol(w) is None else 0)
                  for a, w in zip(["", *ws], ws, strict=False))
        want[i, held(i), len(ws), sum(count[w] > 0 for w in ws), round(base, 6), round(own, 6)] += 1
    assert collections.Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    assert katz.scores(nothing).count() == 0


def test_katz_models_every_word(spark):
    """More words than any former bound; bigrams of rare words have counts, histories and backoff weights of their own."""
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(f"v{int(x)}" for x in rng.zipf(1.4, 30) % 200)) for i in range(200)] + [(200, None), (201, ""), (5, "again V1 v2"), (None, "v1 v2")]
    texts += [(1000 + i, " ".join(f"a{j} b{j} a{j} {'b' if j % 3 else 'c'}{j}" for j in range(i * 500, i * 500 + 700))) for i in range(280)]
    got = katz.scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, (t or "").lower().split() + ["\n"]) for i, t in texts]
    count = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, kinds = sum(count.values()), len(count)
    assert kinds > 1 << 18
    pairs = collections.Counter((a, b) for i, ws in tokens if not held(i) for a, b in zip(["", *ws], ws, strict=False))
    d = katz.discounts([sum(c == r for c in pairs.values()) for r in range(1, 7)])
    after, followers = collections.Counter(), collections.defaultdict(list)
    for (a, b), c in pairs.items():
        after[a] += c
        followers[a].append(b)
    share = lambda w: (count[w] + 0.1) / (total + 0.1 * (kinds + 1))
    seen = lambda h, w: (d[pairs[h, w] - 1] if pairs[h, w] <= 5 else 1) * pairs[h, w] / (after[h] + 1)

    @functools.cache
    def backoff(h):
        return (1 - sum(seen(h, w) for w in followers[h])) / (1 - sum(map(share, followers[h])))
    want = collections.Counter()
    for i, ws in tokens:
        base = sum(math.log10(share(w)) for w in ws)
        own = sum(math.log10(seen(h, w) if (h, w) in pairs else backoff(h) * share(w)) for h, w in zip(["", *ws], ws, strict=False))
        want[i, held(i), len(ws), sum(count[w] > 0 for w in ws), total, round(base, 5), round(own, 5)] += 1
    assert collections.Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got) == want
    assert katz.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    good = [(i, " ".join(f"word{(i * 31 + j * 17) % 97}n{i}x{j}" for j in range(60)), "en", "s", 1) for i in range(80)]
    bad = [(200 + i, "BUY!!! NOW!!! " * 20 + str(i), "en", "s", 1) for i in range(40)]
    copies = [(300 + i, good[0][1], "en", "s", 1) for i in range(3)]
    passage = [(400 + i, " ".join(f"own{i}a{j}" for j in range(40)) + " " + PASSAGE, "en", "s", 1) for i in range(2)]
    leak = [(500, " ".join(f"l{j}" for j in range(30)) + " the secret test item of this benchmark stands here in full", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(good + bad + copies + passage + leak, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "The secret test item of this benchmark stands here in full")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert not any(200 <= i < 300 for i in left[0]) and len(left[0]) == 86
    assert not any(300 <= i < 400 for i in left[1]) and len(left[1]) == 83
    assert left[2][400] == " ".join(f"own0a{j}" for j in range(40)) and left[2][1] == left[1][1]
    assert 500 not in left[3] and len(left[3]) == 82
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 82


def test_arrow_types_survive(spark):
    rows = spark.createDataFrame([(1, "a b", [1, 2], {"k": 1.5})], "doc_id long, text string, l array<int>, m map<string,double>")
    assert substrings.remove_repeats(rows).select("doc.*").first() == rows.first()
    assert isinstance(pa.array([1]), pa.Array)


@pytest.mark.parametrize("rows", list(itertools.permutations([(3, "B"), (5, "A"), (5, "B")])))
def test_near_dedup_loses_no_text(spark, rows):
    """Two texts of one id in different groups: each group keeps one document."""
    text = {"A": "one sentence about green apples and their many uses in the kitchen", "B": "nothing of the kind stands in this second and rather longer text at all"}
    docs = spark.createDataFrame([(i, text[t], "x") for i, t in rows], "doc_id long, text string, key string")
    kept = sorted(tuple(r) for r in simhash.keep_first(docs).collect())
    assert kept == [(3, text["B"], "x"), (5, text["A"], "x")]


def test_near_dedup_keeps_one_of_two_texts_of_an_id(spark):
    long = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(5, long + " end", 1), (5, long, 1), (5, long, 1), (7, long, 2), (None, long, 3), (None, "", 4)], "doc_id long, text string, n int")
    kept = simhash.keep_first(docs).collect()
    assert sorted(r.n for r in kept) == [1, 3, 4] and [r.doc_id for r in kept if r.n == 1] == [5]
    assert simhash.keep_first(docs.limit(0)).collect() == []
