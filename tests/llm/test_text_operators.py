"""Operators on texts against brute force, and their edge cases."""

import gc
import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promptloom.llm import line_dedup, mixing, ngram_join, packing, queries, quality_rules, suffix_dedup, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `_found` int, spans string"
LONG = " ".join(f"word{i % 97}x{i % 13}" for i in range(4000))
BASE = " ".join(f"base{i}" for i in range(60))
EDGE = [
    (1, BASE, "en", "a", 3, 1, "x"),
    (2, BASE + " more", "en", "a", 3, 1, "x"),
    (3, BASE, "en", None, 3, 1, "x"),
    (3, BASE, "en", None, 3, 1, "x"),
    (4, None, None, None, None, None, None),
    (5, "", "en", "a", 0, 1, "x"),
    (6, "  \n\t ", "de", "b", 0, 1, "x"),
    (7, "Two Words", "de", "b", 0, 1, "x"),
    (8, "two words", "de", "b", 0, 1, "x"),
    (None, BASE + " other ende", "en", "a", 0, 1, "x"),
    (9, LONG, "en", "b", 0, 1, "x"),
    (10, LONG[:12000] + "\n" + LONG, "en", "b", 0, 1, "x"),
    (11, "zß" * 200 + "\n" + "zß" * 200, "fr", "c", 0, 1, "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# --- lines ---------------------------------------------------------------------------------------


def brute_lines(docs):
    def norm(line):
        import re

        return re.sub(r"[\x20\x09-\x0D,.;:!?]*(?:[\x20\x09-\x0D]|$)[\x20\x09-\x0D]*", " ", line.lower()).strip(" ")

    seen, out = set(), {}
    for i, text in sorted(docs):
        at, spans, kept = 0, [], []
        for line in text.split("\n"):
            key = norm(line)
            if len(key.split(" ")) >= line_dedup.LEAST_WORDS and key in seen:
                spans.append(f"{at}:{at + len(line)}")
            else:
                kept.append(line)
                seen.add(key)
            at += len(line) + 1
        out[i] = (",".join(spans), "\n".join(kept))
    return out


def test_lines_equal_brute_force(real):
    expected = brute_lines(rows(real, "doc_id", "text"))
    found = {i: (s, t) for i, s, t in rows(line_dedup.dedup(real), "doc_id", "spans", "text")}
    assert found == expected
    assert any(s for s, _ in found.values())


def test_lines_edge_cases(edge, empty):
    found = line_dedup.dedup(edge)
    assert found.count() == len(EDGE)
    by_id = defaultdict(list)
    for i, text in rows(found, "doc_id", "text"):
        by_id[i].append(text)
    assert by_id[1] == [BASE] and by_id[3] == ["", ""] and by_id[4] == [""] and by_id[6] == ["  \n\t "]
    assert line_dedup.dedup(empty).count() == 0


def brute_runs(docs, least_run):
    """Runs of repeated sentences, of documents in the order of their ids."""
    norm = r"[\x20\x09-\x0D,.;:!?]*(?:[\x20\x09-\x0D]|$)[\x20\x09-\x0D]*"
    seen, out = set(), {}
    for i, text in sorted(docs):
        units, at = [], 0  # line, place, text, normalised
        for line_no, line in enumerate((text or "").split("\n")):
            for unit in re.split(r"(?<=[.!?][\x20\x09\x0B-\x0D])", line):
                units.append((line_no, at, unit, re.sub(norm, " ", unit.lower()).strip(" ")))
                at += len(unit)
            at += 1
        compared = [k for k, u in enumerate(units) if u[3]]
        again = []
        for k in compared:
            again.append(units[k][3] in seen)
            seen.add(units[k][3])
        gone, start = set(), 0
        for end in range(len(compared) + 1):
            if end == len(compared) or not again[end]:
                run = compared[start:end]
                if run and (sum(len(units[k][3].split(" ")) for k in run) >= least_run or len(run) == len(compared)):
                    gone.update(run)
                start = end + 1
        lines = {}
        for k, u in enumerate(units):
            if k not in gone:
                lines[u[0]] = lines.get(u[0], "") + u[2]
        spans = ",".join(f"{units[k][1]}:{units[k][1] + len(units[k][2])}" for k in sorted(gone))
        out[i] = (len(units), sum(again), len(gone), spans, "\n".join(lines.values()))
    return out


RUN_COLUMNS = ("n_units", "n_repeated", "n_removed", "spans", "text")


def test_query_removes_runs_of_repeated_sentences(spark, real):
    found = {r[0]: r[1:] for r in rows(queries.op1_line_dedup(spark, SF), "doc_id", *RUN_COLUMNS)}
    assert found == brute_runs(rows(real, "doc_id", "text"), line_dedup.LEAST_RUN)
    assert sum(r[1] > r[2] > 0 for r in found.values()) > 0


def test_runs_across_lines_blanks_and_cuts(spark):
    first = "One two three. Four five six! Seven eight?\n\nNine ten. Eleven"
    texts = [
        first, first, "New. One two three. Four five six! New again.", "one TWO three.\n\n \nfour five, six\nnew", "Nine ten.", "Nine ten.  ",
        "Nine ten. Other words. Nine ten. Nine ten.", None, "", "...\n! ?", "Four five six! Seven eight?",
    ]
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for least in (0, 4, 6, 100):
        found = line_dedup.dedup(df, least_words=1, sentences=True, least_run=least)
        assert {r[0]: r[1:] for r in rows(found, "doc_id", *RUN_COLUMNS)} == brute_runs(docs, least)
    # repeated rows are one document; other columns are not read
    twice = df.union(df).withColumn("gone", F.lit(1)).withColumn("copy", F.lit("x")).withColumn("n_repeated", F.lit(None))
    found = line_dedup.dedup(twice, least_words=1, sentences=True, least_run=6)
    assert sorted(rows(found, "doc_id", *RUN_COLUMNS), key=str) == sorted(2 * [(i, *v) for i, v in brute_runs(docs, 6).items()], key=str)


def test_a_document_of_many_lines(spark):
    lines = [f"line {i} of a long document" for i in range(25_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines + lines)), (2, lines[0])], "doc_id bigint, text string")
    found = {r[0]: r[1:] for r in rows(line_dedup.dedup(docs, least_words=1, sentences=True, least_run=18), "doc_id", "n_units", "n_removed", "text")}
    assert found == {1: (50_000, 25_000, "\n".join(lines)), 2: (1, 1, "")}


def test_short_lines_and_copies_of_them(spark):
    docs = spark.createDataFrame([(1, "one\ntwo words\n\n"), (2, "One.\nTWO  words\n\n"), (3, "new\none")], "doc_id bigint, text string")
    found = rows(line_dedup.dedup(docs, least_words=1), "doc_id", "text", "n_removed")
    assert sorted(found) == [(1, "one\ntwo words\n\n", 0), (2, "\n", 2), (3, "new", 1)]


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, f"{BASE}\n\nshort\n\n{BASE}")], "doc_id bigint, text string")
    assert rows(line_dedup.dedup(docs, separator="\n\n"), "text", "n_removed") == [(f"{BASE}\n\nshort", 1)]


# --- statistics and outliers -------------------------------------------------------------------------


def brute_statistics(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    chars = sum(len(w.decode()) for w in words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), chars, symbols, dup, len(covered), failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_statistics_equal_brute_force(spark, real, edge):
    for docs in (real, edge):
        found = rows(quality_rules.judge(docs), "doc_id", *COLUMNS)
        expected = [(i, *brute_statistics(t)) for i, t in rows(docs, "doc_id", "text")]
        assert sorted(found, key=str) == sorted(expected, key=str)


def test_outliers_are_rejected(spark, empty):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(400)]
    clean = [(i, " ".join(rng.choice(words, rng.integers(60, 900))) + ".") for i in range(400)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in rng.choice(words, 200))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in clean + junk], "doc_id bigint, text string, lang string, source string")
    kept = dict(rows(quality_rules.judge(docs), "doc_id", "kept"))
    assert all(kept[i] for i, _ in clean) and not any(kept[i] for i, _ in junk)
    assert quality_rules.judge(empty).count() == 0


def test_chi_squared():
    assert abs(quality_rules.chi2_quantile(0.95, 6) - 12.5916) < 1e-3
    assert abs(quality_rules.chi2_below(5.0, 4) - 0.712703) < 1e-5


# --- suffixes --------------------------------------------------------------------------------------


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = rng.integers(1, rng.integers(2, 5), rng.integers(1, 60))
        assert suffix_dedup.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def brute_suffixes(docs, span=suffix_dedup.SPAN):
    first, out = {}, {}
    for i, text in sorted(docs):
        for p in range(len(text) - span + 1):
            first.setdefault(text[p : p + span], (i, p))
    for i, text in docs:
        gone = bytearray(len(text))
        for p in range(len(text) - span + 1):
            if first[text[p : p + span]] != (i, p):
                gone[p : p + span] = b"\1" * span
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def suffix_rows(docs):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted(rows(suffix_dedup.dedup(docs), *names), key=str)


def test_suffixes_equal_brute_force(spark, real, edge, empty):
    for docs in (real.where("doc_id < 120"), edge):
        texts = [(-1 if i is None else i, (t or "").encode()) for i, t in rows(docs, "doc_id", "text")]
        expected = brute_suffixes(texts)
        found = suffix_rows(docs)
        assert found == sorted([((None if i == -1 else i), *expected[i]) for i, _ in texts], key=str)
        assert any(r[2] for r in found)
    assert suffix_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("kinds", [2_000, 3])
def test_suffixes_of_shifted_and_periodic_passages(spark, monkeypatch, kinds):
    # few kinds make anchors hot, so that their stretches are dealt out again
    monkeypatch.setattr(suffix_dedup, "MOST_KINDS", kinds)
    rng = np.random.default_rng(5)

    def noise(n):
        return "".join(rng.choice(list("abcdefghij "), n))

    passage = noise(700)
    texts = [noise(150) + passage[rng.integers(0, 300) : rng.integers(400, 700)] + noise(150) for _ in range(30)]
    line = noise(70)
    texts += [noise(90) + line + noise(rng.integers(0, 90)) for _ in range(12)]
    texts += [passage[80:140] + line + passage[200:260] for _ in range(3)]
    texts += ["ab" * 400, noise(10) + "ab" * 300, "q" * 99, "q" * 100, "q" * 101, "é" * 120]
    docs = [(i, t) for i, t in enumerate(texts)]
    expected = brute_suffixes([(i, t.encode()) for i, t in docs])
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert suffix_rows(df) == sorted([(i, *expected[i]) for i, _ in docs], key=str)


# --- n-gram join -----------------------------------------------------------------------------------


def brute_join(docs):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    shared = Counter((a, b) for ids in by.values() for k, b in enumerate(sorted(ids)) for a in sorted(ids)[:k])
    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_join_equals_brute_force(spark, real):
    expected = brute_join(rows(real, "doc_id", "text"))
    found = {i: (n, c) for i, n, c in rows(ngram_join.jaccard_components(real), "doc_id", "n_shingles", "component_id")}
    assert found == expected


def test_join_of_many_near_copies(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(500)])
    docs = []
    for group in range(4):
        base = rng.choice(words, 120)
        for _ in range(40):
            copy = base.copy()
            copy[rng.integers(0, 120, rng.integers(0, 6))] = "changed"
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs) + i, " ".join([*rng.choice(words, 50), *words[:40]])) for i in range(60)]
    expected = brute_join(docs)
    # small limits, so that groups are cut and blocks meet
    monkeypatch.setattr(ngram_join, "MOST_TEXTS", 10)
    monkeypatch.setattr(ngram_join, "MOST_POINTS", 16)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    found = {i: (n, c) for i, n, c in rows(ngram_join.jaccard_components(df), "doc_id", "n_shingles", "component_id")}
    assert found == expected


def test_join_meets_near_copies_once(spark, monkeypatch):
    # two documents that share four fifths of their shingles, and copies of one below the limit to the other
    base = [f"w{i}" for i in range(400)]
    other = base[:200] + [f"v{i}" for i in range(40)] + base[240:]
    docs = [(1, " ".join(base)), (2, " ".join(other))]
    sizes, columns = defaultdict(list), defaultdict(list)
    real_written = ngram_join.written

    def written(df, name):
        out = real_written(df, name)
        sizes[name].append(out.count())
        columns[name].append(set(out.columns))
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {i: (n, c) for i, n, c in rows(ngram_join.jaccard_components(df), "doc_id", "n_shingles", "component_id")}
    assert found == brute_join(docs)
    # all elements that both hold in their first ones bring the same two documents together
    assert sizes["mixed"] == [1]
    # points and first elements are not written again with the components of each round
    assert sum("point" in c for name in columns for c in columns[name]) == 2


def test_join_of_components_near_each_other(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = np.array([f"w{i}" for i in range(200)])
    docs = []
    for family in range(3):
        own = base.copy()
        own[family * 60 : family * 60 + 14] = [f"f{family}_{i}" for i in range(14)]
        for _ in range(15):
            copy = own.copy()
            copy[rng.integers(0, 200, rng.integers(0, 3))] = f"c{len(docs)}"
            docs.append((len(docs), " ".join(copy)))
    docs += [(3, "an id of two texts " + docs[20][1]), (3, None)]
    once = [d for i, d in enumerate(docs) if i < 45 and d[0] != 3]
    monkeypatch.setattr(ngram_join, "MOST_VERIFIED", 2_000)
    monkeypatch.setattr(ngram_join, "MOST_POINTS", 8)
    monkeypatch.setattr(ngram_join, "ORDERS", 0)
    df = spark.createDataFrame(once, "doc_id bigint, text string").repartition(3)
    found = {i: (n, c) for i, n, c in rows(ngram_join.jaccard_components(df), "doc_id", "n_shingles", "component_id")}
    assert found == brute_join(once)
    both = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert ngram_join.jaccard_components(both).count() == len(docs)


def test_join_edge_cases(edge, empty):
    found = Counter(rows(ngram_join.jaccard_components(edge), "doc_id", "n_shingles", "component_id"))
    n = len(BASE.split()) - 3
    assert found[(1, n, 1)] == 1 and found[(2, n + 1, 1)] == 1 and found[(3, n, 1)] == 2
    assert found[(4, 0, 4)] == 1 and found[(5, 0, 5)] == 1 and found[(6, 0, 6)] == 1
    assert found[(7, 1, 7)] == 1 and found[(8, 1, 7)] == 1 and found[(None, n + 2, None)] == 1
    assert ngram_join.jaccard_components(empty).count() == 0


def test_tree_finds_all_pairs_within_the_bound():
    rng = np.random.default_rng(2)
    high = rng.poisson(3, (150, 128)).astype(np.int32)
    high[::3] = high[0]
    sizes = high.sum(axis=1).astype(np.int64)
    found = {(min(i, j), max(i, j)) for a, b in ngram_join.near_points(high, sizes, 85) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    expected = set()
    for i in range(150):
        for j in range(i):
            shared = np.minimum(high[i], high[j]).sum()
            if 185 * shared >= 85 * (sizes[i] + sizes[j]):
                expected.add((j, i))
    assert found >= expected


# --- token counts ------------------------------------------------------------------------------------


def greedy(word, pieces):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not k:
            return None
        word, n = word[k:], n + 1
    return n


def test_automaton_equals_greedy_pieces():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pieces = {bytes(rng.choice(list(b"abc"), rng.integers(1, 5)).tolist()) for _ in range(8)}
        automaton = token_counts.Automaton(pieces)
        for _ in range(40):
            word = bytes(rng.choice(list(b"abc"), rng.integers(1, 12)).tolist())
            assert automaton.count(word) == (greedy(word, pieces) or 1), (pieces, word)


def test_token_counts(spark, real, edge, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = set(token_counts.byte_pieces(path))
    assert all(bytes([b]) in pieces for b in range(256))
    for docs in (real.limit(40), edge):
        expected = []
        for i, text in rows(docs, "doc_id", "text"):
            counts = [greedy(b" " + w, pieces) for w in (text or "").encode().split()]
            expected.append((i, len(counts), sum(counts), max(counts, default=0)))
        found = rows(token_counts.count_tokens(docs, path), "doc_id", "n_words", "n_tokens", "longest_word")
        assert sorted(found, key=str) == sorted(expected, key=str)
    assert token_counts.count_tokens(empty, path).count() == 0


# --- packing -----------------------------------------------------------------------------------------


def test_packing_is_whole_and_gapless(spark, real, edge, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for docs in (real, edge):
        found = packing.pack_documents(docs, path).collect()
        texts = defaultdict(list)
        for i, t in rows(docs, "doc_id", "text"):
            texts[i].append(t)
        by_doc = defaultdict(list)
        for r in found:
            by_doc[r.doc_id].append(r)
        for i, ts in texts.items():
            ids = tokenizer.encode(ts[0] or "", add_special_tokens=False).ids + [1]
            parts = sorted(by_doc[i], key=lambda r: r.start)
            assert sum(r.length for r in parts) == len(ids) * len(ts)
            for r in parts:
                piece = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
                assert (zlib.crc32(piece), r.doc_tokens) == (r.ids_crc32, len(ids))
        by_sequence = defaultdict(list)
        for r in found:
            by_sequence[r.sequence_id].append(r)
        for parts in by_sequence.values():
            at = 0
            for r in sorted(parts, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048
    assert packing.pack_documents(empty, path).count() == 0


def test_runs_are_learned_together():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    made = ["".join(rng.choice(list("abcdefgéñü"), 7)) for _ in range(500)]
    texts = [
        None, "", " ", "\n\n \n", "İstanbul ISTANBUL, ÀÉ!! don't it's a\tb\r\nc  d <|endoftext|>x 12ab ñandú!!?; Σίσυφος ΑΣ, ΑΣ",
        "ªº µ!! A.B. a,b, $$$ %% İ i̇ ﬁ ǅ ŉ ẞ 'S 'LL x\u2003y", " ".join(made), " ".join(w.title() + "," for w in made[:50]),
    ]
    expected = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    runs = packing._Runs(path)
    calls, encode = [], runs._encode
    runs._encode = lambda words: calls.append(len(words)) or encode(words)
    assert runs.encode(pa.array(texts).slice(2)) == expected[2:]
    # words of letters are not handed over one by one
    assert sum(calls) < 60
    assert runs.encode(pa.array(texts)) == expected
    # without marks at the ends of words they are, with the same ids
    plain = packing._Runs(path)
    plain.closes = None
    assert plain.encode(pa.array(texts)) == expected


def test_packing_remembers_runs_in_few_bytes():
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(5)
    made = ["".join(w) for w in rng.choice(list("abcdefghij"), (30_000, 9))]
    text = pa.array([" ".join(made)])
    runs = packing._Runs(path)
    gc.collect()
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    first = zlib.crc32(runs.encode(text)[0])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 150 * len(set(made))
    # the second time no word is encoded, and the ids are the same
    runs._encode_words = runs._encode = None
    assert zlib.crc32(runs.encode(text)[0]) == first
    assert first == zlib.crc32(np.array(runs.tokenizer.encode(" ".join(made), add_special_tokens=False).ids, dtype="<u4").tobytes())


def test_plan_places_every_piece_once_and_tightly():
    rng = np.random.default_rng(6)
    counts = {int(s): int(n) for s, n in enumerate(rng.poisson(40, 256), 1) if n}
    plan = packing.plan_patterns(counts, 256)
    placed = Counter()
    for used, whole in plan:
        assert sum(s * n for s, n in used.items()) <= 256
        for s, n in used.items():
            placed[s] += n * whole
    assert placed == Counter(counts)
    assert sum(w for _, w in plan) <= 1.03 * sum(s * n for s, n in counts.items()) / 256


def test_sequences_hold_the_ids(spark, real):
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = packing.pieces(real.limit(30), path, with_ids=True).cache()
    for r in packing.sequences(packing.pack(cut)).collect():
        assert len(r.ids) == 4 * r.n_tokens <= 4 * 2048


# --- mixing ------------------------------------------------------------------------------------------


def test_fill_shares_shortages():
    assert mixing.fill(100, np.array([1.0, 1, 2]), np.array([10.0, 100, 100])).tolist() == [10, 30, 60]
    assert mixing.fill(500, np.array([1.0, 0]), np.array([10.0, 20])).tolist() == [10, 20]
    assert mixing.fill(0, np.array([1.0]), np.array([5.0])).tolist() == [0]


def test_mixing_meets_budgets(spark, real, edge, empty):
    taken = mixing.copies(real, queries.WEIGHTS, most_epochs=2, share=0.8, seed=7, domain=queries.domain()).toPandas()
    assert len(taken) == real.count() and set(taken["copies"]) <= {0, 1, 2}
    leaves = taken.groupby(["domain", "lang", "source"])["budget"].first()
    assert abs(leaves.sum() / (0.8 * taken["tokens"].sum()) - 1) < 1e-6
    for _, leaf in taken.groupby(["domain", "lang", "source"]):
        used, budget = (leaf["tokens"] * leaf["copies"]).sum(), leaf["budget"].iloc[0]
        assert used <= budget + 1e-3 and budget <= 2 * leaf["tokens"].sum() + 1e-3
        # the prefix ends where the next document would not fit
        assert budget - used <= leaf["tokens"].max()
    again = mixing.copies(real.repartition(7), queries.WEIGHTS, most_epochs=2, share=0.8, seed=7, domain=queries.domain())
    assert Counter(rows(again, "doc_id", "copies")) == Counter(zip(taken["doc_id"], taken["copies"], strict=True))
    some = mixing.copies(edge, {("all",): 1.0})
    assert some.count() == len(EDGE) and mixing.mixed(edge, some).count() >= len(EDGE)
    assert mixing.copies(empty, {}).count() == 0


def test_mixing_fills_siblings_before_ancestors(spark):
    made = [(i, "w " * 100, lang, f"s{i % 2}") for i, lang in enumerate(["en"] * 2 + ["de"] * 20 + ["fr"] * 40)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string")
    weights = {("a",): 1.0, ("b",): 1.0}
    part = F.when(F.col("lang") == "fr", "b").otherwise("a")
    taken = mixing.copies(docs, {**weights, ("a", "en"): 1.0, ("a", "de"): 1.0}, total=2000.0, domain=part).toPandas()
    by_lang = taken.groupby(["lang", "source"])["budget"].first().groupby("lang").sum()
    # English has 200 of its 500, German makes up for it, French gets no more than its half
    assert by_lang.round(6).to_dict() == {"en": 200.0, "de": 800.0, "fr": 1000.0}


@pytest.mark.parametrize("unlisted", ["it", None])
def test_unlisted_language_leaves_room_for_its_siblings(spark, unlisted):
    made = [(i, "w " * 100, lang, "s") for i, lang in enumerate(["en"] * 50 + ["de"] * 17 + [unlisted] * 33)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string")
    weights = {("all",): 1.0, ("all", "en"): 0.55, ("all", "de"): 0.15}
    taken = mixing.copies(docs, weights, most_epochs=2, total=5000.0).toPandas()
    by_lang = {(None if lang is None or lang != lang else lang): b for lang, b in zip(taken["lang"], taken["budget"], strict=True)}
    # 0.33 of the room, times the 0.7 of its siblings, beside these
    parts = {"en": 0.55, "de": 0.15, unlisted: 0.33 * 0.7}
    assert all(abs(by_lang[k] - 5000 * w / sum(parts.values())) < 1e-6 for k, w in parts.items())
