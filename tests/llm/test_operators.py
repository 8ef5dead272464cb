"""The text operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivelake.llm import bitslice, chat, components, decontaminate, fm_index, hamming_search, html_extract, mixing, simhash, suffix_dedup, suffix_sort, token_output, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp int, key string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def texts():
    base = words(120, 1)
    edited = base.split()
    edited[60] = "other"
    return [
        (0, base, "s1"), (1, None, "s1"), (2, "", None), (3, base, "s2"), (4, " ".join(edited), "s2"), (5, "one", "s3"), (6, words(4000, 2), "s3"),
        (7, "x" * 700, "s1"), (8, "ab" * 300 + "\n  spaced   out \t text é", "s4"), (9, base[50:400], None), (10, "one", "s3"), (11, "x" * 300, "s4"),
        (None, "no id here", "s5"), (10, "one", "s3"), (10, "same id, another text", "s1"), (12, words(40, 3) + " " + base[:150], "ß"), (13, "a  b\n\nc \n d", "s5"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, None, "x", 1, "k") for i, t, s in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- 1


def test_tokens_whole_texts(docs, none, spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_output.tokenizer_file())
    path = f"file://{tmp_path}/ids"
    files = token_output.write_token_files(docs, path, token_output.tokenizer_file())
    got = rows_of(token_output.digests(files))
    expected = Counter()
    for i, t, _ in texts():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        expected[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    assert token_output.encode_documents(none).count() == 0

    import glob

    import pyarrow.parquet as pq

    meta = pq.ParquetFile(sorted(glob.glob(f"{tmp_path}/ids/*.parquet"))[-1]).metadata.row_group(0)
    coded = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in coded["doc_id"].encodings and coded["ids.list.element"].has_dictionary_page
    assert all(c.has_offset_index and c.has_column_index for c in coded.values())


def test_encoder_cuts(spark):
    from tokenizers import Tokenizer

    own, e = Tokenizer.from_file(token_output.tokenizer_file()), token_output.Encoder(token_output.tokenizer_file())
    for x in ["", " ", "\n", "a  b", "x\n\ny", "hi.\nYou're 5, ok?! don't ... 3.14, é, x", "a\tb c", "<|endoftext|> a<|endoftext|>", "a <|endoftext|>", "<|endof text|> |>", "日本 語, x. ' s 's don't", "a.\r\nb c", "x\x1c y", "­ İstanbul ǅ ªº ²³ x", "ab c d"]:
        assert e.encode(x) == np.array(own.encode(x, add_special_tokens=False).ids, "<i4").tobytes(), x
    assert np.frombuffer(e.encode("end <|endoftext|>"), "<i4")[-1] == own.token_to_id("<|endoftext|>")


def test_encoder_of_many_texts():
    """Texts at random with all that cuts depend on, many at once; a word is remembered once, whatever stands next to it."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    own, e, r = Tokenizer.from_file(token_output.tokenizer_file()), token_output.Encoder(token_output.tokenizer_file()), random.Random(3)
    parts = [*"aAztSrevdlm09.,-!?(<|> \n\t\r\x0b\x1c\x00\x7f\x85\u00a0\u3000\u2009\u0301éß²½一́😀İǅ_'’", "'s", "'re", "it's", " ", "  ", " the", "\n\n", "<|endoftext|>"]
    many = ["".join(r.choice(parts) for _ in range(r.randrange(25))) if i % 50 else None for i in range(6000)]
    for at in (0, 1, 3, 2000):
        some = many[at : at + max(1, at)] if at < 2000 else many[at:]
        ids, counts = e.encode_all(pa.array(many)[at : at + len(some)])
        assert counts.tolist() == [len(x.ids) for x in own.encode_batch([t or "" for t in some], add_special_tokens=False)]
        assert ids.tolist() == [i for t in some for i in own.encode(t or "", add_special_tokens=False).ids]
    assert e.encode_all(pa.array([], pa.string()))[0].tolist() == []

    e = token_output.Encoder(token_output.tokenizer_file())
    e.encode_all(pa.array([f" word{a}\nnext{b} word{b} word" for a in ".,;!" for b in ("", ".", ",", "?", ":\nnext")]))
    assert sorted(x for x in e.known if x.strip().isalpha()) == [" word", "next"]


# ---------------------------------------------------------------- 2


def fill(sizes, weights, share=1.5, epochs=2):
    """Targets by the repeated resharing that the water level stands for."""
    left, open_, out = share * sum(sizes.values()), dict(sizes), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * level >= epochs * open_[s]]
        if not full:
            return out | {s: weights[s] * level for s in open_}
        for s in full:
            out[s] = epochs * open_.pop(s)
            left -= out[s]
    return out


def test_mix(docs, none, spark):
    many = [(i, words(random.Random(i).randrange(1, 300), i), "en", f"z{(i * i) % 7}" if i % 9 else None, 0, "", 0, "") for i in range(500)]
    for frame in (docs, spark.createDataFrame(many, SCHEMA)):
        got = rows_of(mixing.mix(frame))
        assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix(frame.repartition(5)))))
        sizes = defaultdict(int)
        for r in rows_of(frame.select("source", "text")):
            sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        weights = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
        target = fill(sizes, weights)
        taken = defaultdict(int)
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"]
            assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], abs_tol=1e-6)
            taken[r["source"]] += r["taken"]
        for s in sizes:
            assert abs(taken[s] - target[s]) <= 1.5 * mixing.BLOCK + 0.002 * target[s], (s, taken[s], target[s])
    assert mixing.mix(none).count() == 0


def test_highest_quotients(spark):
    r = random.Random(4)
    for seats in (1, 7, 100, 1003):
        votes = {f"p{i}": float(r.choice([0, 1, 5, 5, 80, 1000])) for i in range(12)}
        frame = spark.createDataFrame([(0, k, v, seats) for k, v in votes.items()], "g int, k string, v double, n long")
        got = {x["k"]: x["quota"] for x in rows_of(mixing.sainte_lague(frame, ["g"], ["k"], "v", "n"))}
        best = sorted(((-v / (2 * j + 1), k, j) for k, v in votes.items() if v for j in range(seats)))[:seats]
        assert got == {k: sum(1 for x in best if x[1] == k) for k in votes}


def test_mixed_rows(docs, none):
    got = rows_of(mixing.mixed(docs))
    drawn = {}
    for r in rows_of(mixing.mix(docs)):
        drawn[r["doc_id"]] = drawn.get(r["doc_id"], 0) + r["draws"]
    for i, n in Counter(r["doc_id"] for r in got).items():
        assert abs(n - drawn[i]) < 2
    assert mixing.mixed(none).count() == 0


# ---------------------------------------------------------------- 3


def slow_fingerprint(text, shingle):
    import xxhash

    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def slow_groups(n, linked):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash(docs, none, spark):
    got = simhash.near_duplicates(docs, shingle=3, exact=True).withColumn("fp", F.lower(F.hex("fp")))
    expected = Counter()
    rows = [(i, slow_fingerprint(t, 3)) for i, t, _ in texts()]
    group = slow_groups(len(rows), lambda i, j: (rows[i][1] ^ rows[j][1]).bit_count() <= 2)
    low = defaultdict(list)
    for (i, _), g in zip(rows, group):
        low[g] += [] if i is None else [i]
    for (i, f), g in zip(rows, group):
        expected[i, f"{f:016x}", min(low[g], default=None)] += 1
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in rows_of(got)) == expected
    assert simhash.near_duplicates(none, 3, True).count() == 0 and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot", [8192, 3])
def test_links_of_fingerprints(spark, monkeypatch, hot):
    """Both exact ways: pieces of candidates, and neighbours for hot keys."""
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(9)
    seeds = [r.getrandbits(64) for _ in range(30)] + [0]
    fps = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4]))) for s in seeds for _ in range(12)})
    frame = spark.createDataFrame([(bytearray(f.to_bytes(8, "big")), k) for k, f in enumerate(fps)], "fp binary, low long")
    found = {bytes(x["node"]["fp"]): bytes(x["component"]["fp"]) for x in rows_of(components.components(simhash.link_exact(frame)))}
    group = slow_groups(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    for f, g in zip(fps, group):
        if group.count(g) > 1:
            assert found[f.to_bytes(8, "big")] == fps[g].to_bytes(8, "big")
        else:
            assert f.to_bytes(8, "big") not in found


def test_bit_sliced_blocks():
    r = np.random.default_rng(3)
    fps = r.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    for i in range(0, 290, 10):
        fps[i + 1] = fps[i] ^ np.array([1 << int(r.integers(60)), 3], np.uint64)
    for radius in (2, 3, 40):
        group = slow_groups(300, lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= radius)
        assert bitslice.local_components(fps, radius).tolist() == group
    # many keys at once, small and large ones
    keys = np.sort(r.choice([*[0] * 150, *range(1, 60)], 300))
    for radius in (2, 40, 127):
        group = slow_groups(300, lambda i, j: keys[i] == keys[j] and int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= radius)
        assert bitslice.pooled(keys, fps, radius).tolist() == group


def test_candidates_of_a_hot_key(spark, monkeypatch):
    """All fingerprints under one key, many runs of them: members of runs meet, not their roots alone."""
    monkeypatch.setattr(simhash, "HELD", 16)
    r, fps = random.Random(4), []
    for _ in range(3):
        f = r.getrandbits(256)
        for _ in range(50):
            fps.append(f)
            f ^= sum(1 << b for b in r.sample(range(256), 40))
    r.shuffle(fps)
    frame = spark.createDataFrame([(bytearray(f.to_bytes(32, "little")), bytearray()) for f in fps], "fp binary, first binary").coalesce(1)
    found = {bytes(x["node"]["fp"]): bytes(x["component"]["fp"]) for x in rows_of(components.components(simhash.link_near(frame, radius=44, tables=1, key_bits=0)))}
    group = slow_groups(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 44)
    assert len(set(group)) == 3 and len(found) == len(fps)
    assert len({(g, found[f.to_bytes(32, "little")]) for f, g in zip(fps, group)}) == 3 == len(set(found.values()))


def test_near_duplicates_of_wide_fingerprints(spark):
    rows, r = [], random.Random(5)
    for g in range(25):
        base = words(300, 100 + g, 5000).split()
        for c in range(4):
            copy = list(base)
            for _ in range(c):
                copy[r.randrange(len(copy))] = f"n{r.randrange(9999)}"
            rows.append((10 * g + c, " ".join(copy)))
    shingles = [{" ".join(t.split()[i : i + 5]) for i in range(296)} for _, t in rows]
    found = {x["doc_id"]: x["component_id"] for x in rows_of(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.85 * len(shingles[i] | shingles[j])]
    assert len(pairs) > 50 and sum(found[rows[i][0]] == found[rows[j][0]] for i, j in pairs) >= 0.97 * len(pairs)
    assert all(i // 10 == c // 10 for i, c in found.items())
    kept = {x["doc_id"] for x in rows_of(simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert kept == set(found.values())


@pytest.mark.parametrize("run_sets", [2048, 3])
def test_near_duplicates_are_those_of_the_similarity(spark, monkeypatch, run_sets):
    """Pairs on both sides of 0.8 and chains of them, of many and of few shingles: none more and none fewer."""
    monkeypatch.setattr(simhash.link_similar, "__defaults__", (run_sets, 2_000_000))
    r, rows = random.Random(8), []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range([300, 120, 30, 12][g % 4])]
        for c in range(6):
            rows.append((100 * g + c, " ".join(base)))
            for _ in range(max(1, len(base) * 3 // 130)):
                base[r.randrange(len(base))] = f"n{r.randrange(10**9)}"
    of = lambda t: {" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = [of(t) for _, t in rows]
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    group = slow_groups(len(rows), lambda i, j: i // 6 == j // 6 and share(i, j) >= 0.8)
    beside = [share(i, i + 1) for i in range(len(rows) - 1) if i % 6 < 5]
    assert sum(0.7 <= x < 0.8 for x in beside) > 20 and sum(0.8 <= x < 0.87 for x in beside) > 20
    found = {x["doc_id"]: x["component_id"] for x in rows_of(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert found == {i: rows[k][0] for (i, _), k in zip(rows, group)}


def test_deduplicate_keeps_columns_and_one_of_each(docs, none):
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns and simhash.deduplicate(none).count() == 0
    ids = Counter(r["doc_id"] for r in rows_of(out))
    assert ids[0] == 1 and 3 not in ids and ids[5] == 1 and ids[10] == 1 and ids[None] == 1


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, i) for i in range(5001, 5200)] + [(9, 9), (7777, 7777)]
    group = slow_groups(8000, lambda i, j: False)
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in rows_of(components.components(spark.createDataFrame(edges, "u long, v long")))}
    assert got == {i: root(i) for i in up} and len(group) == 8000
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- 4


def slow_removal(rows):
    """By doc_id (null first), then by the order in which rows are given."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                cover[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        out.append((i, len(raw), sum(cover), sum(1 for j, c in enumerate(cover) if c and not (j and cover[j - 1])), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


DIGEST = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot,segment", [(suffix_dedup.HOT, suffix_dedup.SEGMENT), (1, 150)])
def test_repeats(docs, none, monkeypatch, hot, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    unique = docs.dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["text"]) for r in rows_of(unique)), key=lambda x: (x[0] is not None, x[0] or 0))
    got = rows_of(suffix_dedup.remove_repeats(unique, hot=hot))
    assert Counter(tuple(r[c] for c in DIGEST) for r in got) == slow_removal(rows)
    for r in got:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"]
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_repeats_with_repeated_rows(docs):
    got = rows_of(suffix_dedup.remove_repeats(docs.union(docs.filter("doc_id = 6"))))
    assert len(got) == len(texts()) + 1
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 6) == [0, len(words(4000, 2))]


@pytest.mark.parametrize("warm,hot", [(500, 40_000), (1, 40_000), (3, 4)])
def test_repeats_at_random(spark, monkeypatch, warm, hot):
    """Small alphabets, shared passages, edits: many anchors with several kinds of surroundings."""
    monkeypatch.setattr(suffix_dedup, "WARM", warm)
    r = random.Random(11)
    passages = ["".join(r.choices("ab ", k=r.randrange(90, 260))) for _ in range(6)] + ["".join(chr(r.randrange(97, 123)) for _ in range(140)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(passages) if r.random() < 0.7 else "".join(r.choices("abcdé\n", k=r.randrange(5, 120))) for _ in range(r.randrange(1, 6))]
        text = "".join(parts)
        if r.random() < 0.5 and len(text) > 50:
            k = r.randrange(len(text))
            text = text[:k] + "#" + text[k + 1 :]
        rows.append((i, text))
    got = rows_of(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), keep=False, hot=hot))
    assert Counter(tuple(x[c] for c in DIGEST) for x in got) == slow_removal(rows)


def test_deep_shallow():
    r = random.Random(1)
    strings = [bytes(r.choices(b"ab", k=r.randrange(0, 60))) for _ in range(700)] + [b"", b"a" * 200, b"a" * 199 + b"b"] * 2
    for shallow in (0, 8, 24):
        order, lcps = suffix_sort.deep_shallow(strings, shallow)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        assert lcps == [0] + [suffix_sort.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]


# ---------------------------------------------------------------- 5


def test_quotes():
    body, quotes, places = chat.split_quotes("Ann wrote:\n> hello there\n>> older, deeper\n\nmy answer\n> > spaced\nend")
    assert body == "my answer\nend" and quotes == [(1, "hello there"), (2, "older, deeper"), (2, "spaced")] and places == [1, 2, 5]
    assert chat.split_quotes(None) == ("", [], []) and chat.words_of(" Héllo,  WORLD! ") == ["héllo", "world"]
    # a passage is the same however its lines are broken; one without words is none
    wide, narrow = chat.units(["one two three four", "five."]), chat.units(["One two", "three", "four, five"])
    assert set(wide) & set(narrow) == {chat.passage_hash(["one", "two", "three", "four", "five"])} and chat.units(["!!", ""]) == {}
    assert [x[:2] for x in chat.quoted_units(quotes, places)] == [(0, 1), (1, 2), (2, 2)]


def test_passages_link_where_lines_do_not(spark):
    """Re-wrapped and cut quotes; a common short line does not outweigh a passage."""
    rows = [
        (0, "A first message of several words\nthat goes on here.\n\nAnd a second paragraph of it."), (1, "yes"), (2, "something else entirely, said in between\nyes"),
        (3, "> A first message of\n> several words that goes\n> on here.\nAgreed."), (4, "> And a second paragraph of it.\n> yes\nFine."), (5, "> yes\nWhy?"), (6, "> A first message of several words\n> [...]\ncut"),
    ]
    got = {r["turn"]: r for r in rows_of(chat.link_messages(spark.createDataFrame([(1, t, "u", x) for t, x in rows], "conv_id long, turn long, role string, text string")))}
    assert [got[t]["parent_turn"] for t in range(7)] == [None, 0, 1, 0, 0, 1, 0]
    assert got[3]["n_quoted"] == got[3]["n_linked"] == 1


def test_reply_order(spark, none):
    rows = [
        (1, 0, "user", "Where is the station?\nAnd the inn?", 5), (1, 1, "bot", "The station is north.", 5), (1, 2, "user", "> And the inn?\nI still need that.", 5),
        (1, 3, "bot", "> I still need that.\n>> And the inn?\nIt is south.", 5), (1, 4, "user", "you said:\n> THE station is north!\nThanks.", 5), (1, 5, None, None, 5),
        (2, 0, "user", "> unknown line\nhi", 5), (2, None, "system", "first", 5), (None, 3, "user", "alone", 5), (2, 0, "user", "> unknown line\nhi", 5),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, body int").repartition(4)
    got = rows_of(chat.link_messages(frame))
    one = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert [one[t]["parent_turn"] for t in range(6)] == [None, 0, 0, 2, 1, 4]
    assert [one[t]["n_linked"] for t in range(6)] == [0, 0, 1, 2, 1, 0]
    assert [t for t in sorted(one, key=lambda t: one[t]["position"])] == [0, 1, 4, 5, 2, 3]
    assert one[4]["body"] == "Thanks." and one[5]["role"] == "unknown" and one[5]["body"] == ""
    two = sorted((r["position"], r["role"], r["body"]) for r in got if r["conv_id"] == 2)
    assert two == [(1, "system", "first"), (2, "user", "hi"), (3, "user", "hi")]
    chats = {r["conv_id"]: r for r in rows_of(chat.chat_texts(chat.link_messages(frame)))}
    assert chats[None]["chat"] == "<|user|>\nalone\n<|end|>\n" and chats[1]["n_messages"] == 6
    assert chat.link_messages(frame.filter("false")).count() == 0


@pytest.mark.parametrize("bucket", [4096, 3])
def test_reply_order_at_random(spark, monkeypatch, bucket):
    monkeypatch.setattr(chat, "BUCKET", bucket)
    r, rows, parents = random.Random(6), [], {}
    for t in range(40):
        up = t - 1 if r.random() < 0.6 or t < 2 else r.randrange(t)
        parents[t] = up if t else None
        quote = f"> line {up}\n" if t and up != t - 1 else ""
        rows.append((7, t, "u", f"{quote}line {t}"))
    got = {x["turn"]: x for x in rows_of(chat.link_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))}
    assert {t: x["parent_turn"] for t, x in got.items()} == parents
    order = []

    # a thread goes on to its end; then side threads, those that hang later first
    def thread(start):
        run = [start]
        while parents.get(run[-1] + 1) == run[-1]:
            run.append(run[-1] + 1)
        order.extend(run)
        for t in reversed(run):
            for c in sorted(c for c in parents if parents[c] == t and c != t + 1):
                thread(c)

    thread(0)
    assert sorted(got, key=lambda t: got[t]["position"]) == order


def test_deep_threads_and_hot_turns(spark):
    """Two interleaved threads nest as deep as there are messages; all messages of a conversation on one turn keep one order."""
    rows = [(1, t, "u", (f"> said in {t - 2}\n" if t > 1 else "") + f"said in {t}") for t in range(300)] + [(2, None, "u", f"note {i}") for i in range(50)] + [(None, 5, "u", f"note {i}") for i in range(50)]
    got = rows_of(chat.link_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)))
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [r["position"] for r in one] == list(range(1, 301)) and all(r["parent_turn"] == r["turn"] - 2 for r in one if r["turn"] > 1)
    # turn 1 goes on from turn 0; then 3, 5, ... below it, and last the even turns
    assert [r["turn"] for r in one] == [0, 1, *range(3, 300, 2), *range(2, 300, 2)]
    for c in (2, None):
        some = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["position"])
        assert [r["seq"] for r in some] == [r["position"] for r in some] == list(range(1, 51)) and {r["body"] for r in some} == {f"note {i}" for i in range(50)}


# ---------------------------------------------------------------- 6


def slow_hits(text, items):
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
    w = cut(text)
    hit, ids = set(), set()
    for key, t in items:
        b = cut(t)
        for s in range(max(1, len(b) - 9) if b else 0):
            g = b[s : s + 10]
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    ids.add(str(key))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 150])
def test_decontamination(docs, none, spark, slice_bytes):
    base = texts()[0][1]
    items = [(1, " ".join(base.split()[10:40])), (2, "one"), (3, ""), (4, None), (5, "Text é"), (6, "w1 w2 w3"), (7, " ".join(words(4000, 2).split()[500:509])), (8, " ".join(base.split()[30:45]).upper() + "!"), (9, "x" * 700)]
    bench = spark.createDataFrame([(k, t, "z") for k, t in items], "item_id long, text string, doc_id string")
    got = rows_of(decontaminate.decontaminate(docs, bench, slice_bytes=slice_bytes))
    expected = Counter((i, *slow_hits(t, items)) for i, t, _ in texts())
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got) == expected
    row = next(r for r in got if r["doc_id"] == 0)
    raw = base.encode()
    assert len(row["kept_text"].encode()) == len(raw) - sum(s["end"] - s["begin"] for s in row["spans"])
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert all(r["n_hit"] == 0 for r in rows_of(decontaminate.decontaminate(docs, bench.filter("false"))))
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in rows_of(clean)))) == sorted(str(i) for (i, *_, bad), n in expected.items() for _ in range(n) if not bad)


def test_index_of_phrases():
    r = np.random.default_rng(0)
    seq = r.integers(0, 5, 3000)
    index = fm_index.FMIndex(seq)
    phrases = r.integers(0, 7, (200, 4))
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        real = [i for i in range(len(seq) - 3) if (seq[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b))) == real


# ---------------------------------------------------------------- 7


def test_toxicity(spark, none):
    r, rows, labels = random.Random(8), [], []
    for i in range(1500):
        bad = r.random() < 0.15
        w = [f"w{r.randrange(300)}" + "".join(r.choices("abcdefgh", k=3)) for _ in range(r.randrange(20, 80))]
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["vile", "rotten", "nasty", "foul"]) + r.choice(["", "ly"])
        rows.append((i, " ".join(w), "en", "s", 0, "", 0, ""))
        if r.random() < 0.6:
            labels.append((i, int(bad), 1))
    rows += [(2000, None, "en", None, None, None, None, None), (2001, "", "en", "s", 0, "", 0, ""), (None, "rotten vile", "en", "s", 0, "", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, 0)], "doc_id long, toxic int, text int")
    model = toxicity.train(docs, marks)
    got = {x["doc_id"]: x for x in rows_of(toxicity.score(docs, model))}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got.values())
    held = [(got[i]["predicted"], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(p and y for p, y in held)
    assert right >= 0.9 * sum(y for _, y in held) and right >= 0.9 * sum(p for p, _ in held)
    # labels of the held-out fold are not learned from
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 1) for i, y, _ in labels], "doc_id long, toxic int, text int")
    again = {x["doc_id"]: x["score"] for x in rows_of(toxicity.score(docs, toxicity.train(docs, flipped)))}
    assert again == {i: x["score"] for i, x in got.items()}
    unknown = toxicity.train(docs, marks.filter("false"))
    assert all(x["predicted"] == 0 for x in rows_of(toxicity.score(docs, unknown)))
    assert toxicity.score(none, model).count() == 0


# ---------------------------------------------------------------- 8


def test_warc(spark, tmp_path):
    import gzip

    pages = [(1, "http://a.example/x", "<title>T\n t</title><p>Hi &amp; <a href='/y'>link</a></p>"), (2, None, None), (1, "http://a.example/x", "<title>T\n t</title><p>Hi &amp; <a href='/y'>link</a></p>"), (None, "u", "")]
    frame = spark.createDataFrame([(*p, b"") for p in pages], "page_id long, url string, html string, record binary")
    source = warc.responses(frame)
    made = rows_of(warc.derivatives(source))
    assert len(made) == 4
    raw = {r["page_id"]: bytes(r["record"]) for r in rows_of(source)}
    for r in made:
        fields, block = warc.read_record(raw[r["page_id"]])
        assert warc.digest(block) == fields["warc-block-digest"] and r["response_id"] == fields["warc-record-id"]
        for kind in ("metadata", "conversion"):
            own, body = warc.read_record(bytes(r[kind]))
            assert own["warc-type"] == kind and own["warc-refers-to"] == fields["warc-record-id"] and own["warc-target-uri"] == fields["warc-target-uri"]
            assert warc.digest(body) == own["warc-block-digest"] and bytes(r[kind]).endswith(b"\r\n\r\n")
    one = next(r for r in made if r["page_id"] == 1)
    meta = warc.read_record(bytes(one["metadata"]))[1].decode()
    assert "title: T t\r\n" in meta and "outlink: /y\r\n" in meta and "source-header-content-type: text/html; charset=utf-8" in meta and one["n_links"] == 1
    assert warc.read_record(bytes(one["conversion"]))[1] == b"Hi & link"
    body = gzip.compress("é".encode("latin-1"))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + f"{len(body):x}\r\n".encode() + body + b"\r\n0\r\n\r\n"
    assert warc.read_record(warc.derive(warc.make_record("response", [("WARC-Record-ID", "<x>")], http))[2])[1] == "é".encode()
    files = rows_of(warc.write_warc(source, f"file://{tmp_path}/warc"))
    whole = b"".join(gzip.decompress(open(f["file"], "rb").read()) for f in files)
    assert sum(f["n_records"] for f in files) == 4 and whole.count(b"WARC/1.1\r\n") == 4


def test_bad_records(spark):
    """Each gives a row, with an error, and what could be read of it."""
    record = lambda http, head=(): warc.make_record("response", [("WARC-Record-ID", "<x>"), *head], http)
    ok = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    cases = [
        (b"", "bad record length", b""), (record(ok + b"\r\n<p>a</p>"), None, b"a"), (record(ok + b"\r\n<p>a</p>").replace(b"Content-Length: ", b"Content-Length: x"), "bad record length", b"a"),
        (record(ok + b"\r\n<p>a</p>")[:-12], "bad record length", None), (record(ok + b"Transfer-Encoding: chunked\r\n\r\nzz\r\n<p>a</p>"), "bad chunk size", b"zz\na"),
        (record(ok + b"Transfer-Encoding: chunked\r\n\r\n4\r\n<p>a\r\n9\r\nb"), "cut-off chunk", b"ab"), (record(ok + b"Content-Encoding: gzip\r\n\r\nplain"), "not decoded: gzip", b"plain"),
        (record(ok + b"Content-Encoding: br\r\n\r\nplain"), "not decoded: br", b"plain"), (record(ok + b"Content-Encoding: deflate\r\n\r\n" + zlib.compress(b"<p>d")[2:-4]), None, b"d"),
        (record(ok + b"Content-Encoding: gzip\r\nContent-Encoding: deflate\r\n\r\n" + zlib.compress(__import__("gzip").compress(b"<p>g"))), None, b"g"), (None, None, None), (record(b"no http at all"), None, b""),
    ]
    frame = spark.createDataFrame([(i, None if c[0] is None else bytearray(c[0]), "x") for i, c in enumerate(cases)], "page_id long, record binary, error string")
    got = {r["page_id"]: r for r in rows_of(warc.derivatives(frame))}
    assert set(got) == {i for i, c in enumerate(cases) if c[0] is not None}
    for i, r in got.items():
        assert r["error"] == cases[i][1], i
        assert cases[i][2] is None or warc.read_record(bytes(r["conversion"]))[1] == cases[i][2], i
    assert warc.derivatives(frame.filter("false")).count() == 0


def test_warc_files_are_read_back(spark, tmp_path):
    import gzip

    pages = [(i, f"http://a.example/{i}", f"<p>page {i} {'long ' * (i % 3 * 40000)}</p>") for i in range(12)]
    source = warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3))
    warc.write_warc(source, f"file://{tmp_path}/w").collect()
    plain = b"".join(bytes(r["record"]) for r in rows_of(source.filter("page_id < 4")))
    (tmp_path / "w" / "plain.warc").write_bytes(plain)
    (tmp_path / "w" / "cut.warc.gz").write_bytes(gzip.compress(plain)[:-60])
    (tmp_path / "w" / "none.warc").write_bytes(b"")
    (tmp_path / "w" / "odd.warc").write_bytes(b"not a record\r\n\r\n")
    got = rows_of(warc.read_warc(spark, f"{tmp_path}/w/*.warc*"))
    whole = Counter(bytes(r["record"]) for r in got if r["file"].endswith(".gz") and "cut" not in r["file"])
    assert whole == Counter(bytes(r["record"]) for r in rows_of(source)) and all(r["type"] == "response" for r in got if r["error"] is None)
    assert [bytes(r["record"]) for r in got if "plain" in r["file"]] == [bytes(r["record"]) for r in rows_of(source.filter("page_id < 4"))]
    assert [r["error"] for r in got if "odd" in r["file"]] == ["no record"] and not any("none" in r["file"] for r in got)
    assert sum(r["error"] is not None for r in got if "cut" in r["file"]) == 1
    again = warc.derivatives(warc.read_warc(spark, f"{tmp_path}/w/part*").filter("type = 'response'"), key="number")
    assert again.count() == 12 and again.filter("error is not null").isEmpty()


def test_warc_query(spark, tmp_path):
    """The query's identifiers are those of the records, behind long fields as well."""
    pages = [(1, "http://a.example/x", "<p>one</p>\r\n\r\nWARC-Record-ID: no\r\n"), (2, None, None), (3, "http://a.example/" + "é/" * 3000, "<p>three</p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in rows_of(warc.op8_warc_derivatives(spark, str(tmp_path)))}
    made = rows_of(warc.derivatives(warc.responses(frame)))
    assert len(got) == len(made) == 3
    for r in made:
        metadata, conversion = (warc.read_record(bytes(r[k]))[0] for k in ("metadata", "conversion"))
        row = got[r["page_id"]]
        assert (row["metadata_id"], row["conversion_id"], row["refers_to"]) == (metadata["warc-record-id"], conversion["warc-record-id"], conversion["warc-refers-to"])
        assert row["refers_to"] == row["response_id"] == metadata["warc-refers-to"] and row["metadata_id"].startswith("<urn:uuid:")


# ---------------------------------------------------------------- 9


def test_search(spark):
    r = np.random.default_rng(7)
    centres = r.standard_normal((6, 64))
    rows = [(i, (centres[i % 6] + 0.6 * r.standard_normal(64)).tolist()) for i in range(400)] + [(1000 + i, centres[0].tolist()) for i in range(60)] + [(2000, None), (None, centres[1].tolist()), (50, centres[2].tolist())]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, code string").repartition(5)
    codes = hamming_search.codes(frame)
    got = defaultdict(list)
    for x in rows_of(hamming_search.top_k(codes, codes.filter("id % 50 = 0").distinct())):
        got[x["query_id"], x["rank"]].append((x["vec_id"], x["distance"]))
    bits = [(i, np.array(v) >= 0) for i, v in rows if v is not None]
    queries = {(i, b.tobytes()) for i, b in bits if i is not None and i % 50 == 0}
    expected = defaultdict(list)
    for i, b in queries:
        near = sorted(((int((np.frombuffer(b, bool) != x).sum()), j is None, j or 0, j) for j, x in bits))[:10]
        for k, (d, _, _, j) in enumerate(near):
            expected[i, k + 1].append((j, d))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in expected.items()}
    assert hamming_search.top_k(codes.filter("false"), codes).count() == 0 and hamming_search.top_k(codes, codes.filter("false")).count() == 0


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<p>a<p>b</p>", "a\nb"), ("<div>x <b>bold</b>,y<br>z</div>", "x bold,y z"), ("plain < text & more", "plain < text & more"),
        ("<body><header>H</header><main><h1>T</h1><p>one</p><aside>ad</aside><form>f<input></form><section class='comments'><p>c</p></section></main><footer>F</footer>", "T\none"),
        ("<article><header><h1>Title</h1></header><p>x &lt;b&gt; caf&eacute;</p><ul><li>1<li>2</ul><div class='share-buttons'>s</div><footer>by</footer></article><article class='comment'>no</article>", "Title\nx <b> café\n1\n2"),
        ("<body><div id='cookie-notice'>c</div><div class=sidebar>s</div><div class='content'><p>real</p>tail</div><div role=navigation>n</div>", "real\ntail"),
        ("<p>cut off <a href='x", "cut off"), ("<script>var a='<p>x</p>';</script><p>y</p>", "y"), ("<p>a&nbsp;&nbsp;b\n c</p>", "a b c"), ("<article><p>one</p><nav>n</nav>two<!-- c --></article>", "one\ntwo"),
    ],
)
def test_extract(page, text):
    assert html_extract.extract(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<body class='home has-sidebar'><div class='site no-sidebar'><article><p>a</p></article></div></body>", "a"), ("<body class='header-fixed sidebar'><div><p>a</p></div></body>", "a"),
        ("<article><header class='entry-header'><h1>T</h1></header><p>a</p></article>", "T\na"), ("<article><div class='article-header'><h1>T</h1></div><p>a</p></article>", "T\na"),
        ("<article><div class='article-header'>by me</div><p>a</p></article>", "a"), ("<div class='social-science'><p>a</p></div><div class='has-header-image'><p>b</p></div>", "a\nb"),
        ("<div id='sidebar'><main class='no-nav'><p>a</p></main></div>", "a"), ("<div class='comments-area'><article><p>c</p></article></div><div><p>a</p></div>", "a"),
        ("<div><p>a</p></div><div class='share-buttons'>s</div><div class='site-footer'>f</div><div class='main_nav'>n</div><div id='comment-12'>c</div><div class='sidebar-right'>r</div>", "a"),
        ("<article><header hidden><h1>T</h1></header><nav class='header'><h2>N</h2></nav><p>a</p></article>", "a"), ("<body><article class='comment'><p>c</p></article><div><p>a</p></div>", "a"),
    ],
)
def test_names_of_boxes(page, text):
    assert html_extract.extract(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<body id='header-fixed'><p>a</p></body>", "a"), ("<article class='post no-comments'><p>a</p></article>", "a"), ("<h1 class='entry-header'>T</h1><p class='search-term'>a</p><div class='social-policy'>b</div>", "T\na\nb"),
        ("<body><form action=/x><input value=v><article><h1>T</h1><p>a</p></article><select><option>o</select></form>", "T\na"), ("<form><h1>T</h1><p>a</p></form>", "T\na"), ("<form><p>mail</p></form><p>a</p>", "a"),
        ("<p title=it's>a</p><p title=\"x>y\">b</p><p title = '>'>c</p>", "a\nb\nc"), ("<div class='content-sidebar-wrap'><main><p>a</p></main><aside>z</aside></div>", "a"),
        ("<div class='comments'><article><h1>c</h1></article></div><div><h1>T</h1><p>a</p></div>", "T\na"), ("<p>a</p>" + "<div x='1' " * 3000, "a"), ("<div>" * 3000 + "<p>a</p>", "a"), ("<p>" + "long text " * 100_000 + "</p>", "long text " * 99_999 + "long text"),
    ],
)
def test_wrappers_and_odd_markup(page, text):
    assert html_extract.extract(page) == text


def test_copies_of_a_page_are_one(spark):
    """The text of a page doesn't hang on how often it stands there, under the same URL or others of its host."""
    page = "<html><body><div class='a1'><p>one</p></div><div class='b2'><p>two</p>three</div></body></html>"
    rows = [(i, f"https://host{n}.example/p{i % 2 * i}", page) for n in (1, 3, 4, 7, 49) for i in range(n)]
    got = rows_of(html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)))
    assert len(got) == len(rows) and {r["text"] for r in got} == {"one\ntwo\nthree"}
    counts = rows_of(html_extract.style_counts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)))
    assert {r["pages"] for r in counts} == {1}


def test_importance_is_that_of_the_model(spark):
    """Composite importance against a plain computation over the merged trees of a host's pages."""
    r = random.Random(6)

    def page(i):
        side = "".join(f"<li>{x}</li>" for x in ("home", "shop", "about")[: r.choice([2, 3])])
        more = f"<div class='m'><h2>{r.choice(['one', 'two'])}</h2><p>{words(5, i)}</p></div>" if i % 3 else ""
        return f"<html><body><div class='s'><ul>{side}</ul></div><div class='b'><p>{words(9, i)}</p><p>{r.choice(['same', words(4, i)])}</p>{more}</div><div class='f'><div>{'x' if i % 5 else 'y'}</div></div></body></html>"

    pages = [page(i) for i in range(12)]
    seen, blocks_of, kinds_of, kids = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text in pages:
        features = defaultdict(lambda: (set(), set()))
        for node in html_extract.walk(html_extract.parse(text)):
            texts, marks = html_extract.direct(node)
            own = " ".join("".join(texts).split())
            features[node.key][0].update([own] if own else [])
            features[node.key][1].add(" ".join(marks))
            if node.parent:
                kids[node.parent.key].add(node.key)
        for key, (own, marks) in features.items():
            seen[key] += 1
            blocks_of[key].update(own)
            kinds_of[key].update(marks)

    def content(key):
        m = seen[key]
        entropy = lambda n: -sum(1 / n * math.log(1 / n, m) for _ in range(n)) if m > 1 else 0
        total, n = sum(1 - entropy(c) for c in blocks_of[key].values()), len(blocks_of[key])
        for k in kids[key]:
            a, b = content(k)
            total, n = total + a, n + b
        return total, n

    low = set()
    for key, m in seen.items():
        total, n = content(key)
        shown = -sum(c / m * math.log(c / m, m) for c in kinds_of[key].values()) if m > 1 else 1
        weight = html_extract.GAMMA ** len(kinds_of[key])
        if n and m >= html_extract.FEWEST and (1 - weight) * min(shown, 1) + weight * total / n < html_extract.LOW:
            low.add(key)
    frame = spark.createDataFrame([(i, f"http://one.example/{i}", x) for i, x in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    (row,) = rows_of(html_extract.low_nodes(html_extract.style_counts(frame)))
    assert row["host"] == "one.example" and set(row["low"]) == low and len(low) >= 3


def test_what_a_site_repeats_goes_from_its_articles(spark):
    """Boxes and marked paragraphs that all pages of a host share, in the article itself; headings and unmarked text stay."""
    page = lambda i: f"<body><article><h1>{words(4, i)}</h1><h2>Method</h2><p>{words(30, i)}</p><p class='k9'>Read more of our fine stories.</p><div class='q7'><h3>Join</h3><p>Join our club today.</p></div><p>{words(20, -i)}</p></article></body>"
    rows = [(i, f"https://site.example/{i}", page(i)) for i in range(9)] + [(50, "https://lone.example/", page(3))]
    got = {r["page_id"]: r["text"] for r in rows_of(html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    for i in range(9):
        assert got[i] == "\n".join([words(4, i), "Method", words(30, i), words(20, -i)])
    assert "Join our club today." in got[50]


def test_site_trees(spark):
    """Boxes without a telling name are known by what the host's pages share."""
    page = lambda i: f"<html><body><div class='a1'><p>Home Shop About</p></div><div class='b2'><p>{words(30, i)}</p><p>{words(9, -i - 1)}</p></div><div class='c3'>All rights, always</div></body></html>"
    rows = [(i, f"https://host.example/p{i}", page(i), 1) for i in range(8)] + [(100, None, page(3), 1), (101, "https://few.example/", page(4), 1), (3, "https://host.example/p3", page(3), 1), (102, "https://host.example/none", None, 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    got = rows_of(html_extract.main_text(frame))
    assert len(got) == len(rows)
    for r in got:
        if "host" in (r["url"] or "") and r["page_id"] < 100:
            assert r["text"] == f"{words(30, r['page_id'])}\n{words(9, -r['page_id'] - 1)}" and r["n_chars"] == len(r["text"])
        elif r["page_id"] in (100, 101):
            assert r["text"].startswith("Home Shop About")
    assert html_extract.main_text(frame.filter("false")).count() == 0
