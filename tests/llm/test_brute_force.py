"""Operators beyond SQL against plain versions of themselves."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from fathomline.llm import cdc, components, exact, mixing, piece, quality, queries, simhash, suffix, tokencount, toxicity, trees, urlfilter

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


# -- 1


def test_targets_fill_up(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = {f"s{i:02}": rng.choice([0, 3, 50, 1000, 7]) for i in range(9)}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        total, free, want = sum(sizes.values()), dict(zip(sorted(sizes), (1, 2, 3) * 3)), {}
        while free:
            share = {s: (total - sum(want.values())) * w / sum(free.values()) for s, w in free.items()}
            over = [s for s in free if share[s] >= 3 * sizes[s]]
            if not over:
                want |= share
                break
            for s in over:
                want[s] = 3.0 * sizes[s]
                del free[s]
        assert {s: pytest.approx(t) for s, t in want.items()} == got


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([1, 5, 20, 200])), rng.choice(["a", "b", "b", "b", None])) for i in range(1500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert (out["copies"].between(0, 3)).all() and (out["taken"] <= 3 * out["size"]).all()
    for _, part in out.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max()
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).toPandas()
    assert (out.sort_values("doc_id")["taken"].to_numpy() == again.sort_values("doc_id")["taken"].to_numpy()).all()
    emitted = mixing.emit_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert emitted.count() == out["copies"].sum()


def test_taken_words_miss_a_target_by_less_than_a_document(spark, docs):
    for frame in (docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        out = mixing.mix(frame).toPandas()
        by = out.groupby("source", dropna=False)
        assert ((by["taken"].sum() - by["target"].first()).abs() <= by["size"].max()).all()


def test_rows_that_differ_in_other_columns_only_are_taken_on_their_own(spark):
    rows = [(1, "a b c", "s", i, {"k": i}) for i in range(30)] + [(2, "a b c", "s", 7, {"k": 7})] * 3 + [(i, "x", "t", 0, None) for i in range(10, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, more int, m map<string,int>")
    copies = {}
    for r in mixing.emit_mix(df).collect():
        copies[r["source"], r["doc_id"], r["more"]] = copies.get((r["source"], r["doc_id"], r["more"]), 0) + 1
    own = mixing.mix(df).groupBy("source", "doc_id").agg(F.sum("copies").alias("n")).collect()
    assert {(r["source"], r["doc_id"]): r["n"] for r in own if r["n"]} == {k[:2]: sum(n for x, n in copies.items() if x[:2] == k[:2]) for k in copies}
    assert len({k[2] for k in copies if k[1] == 1}) > 15


# -- 2


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://a.Example.COM/en/712.html?x#y", "a.example.com", "/en/712.html", "example.com/en/7", "allow"), ("https://other.com/en/1", "other.com", "/en/1", "com/en/", "block"), ("x://com/en/", "com", "/en/", "com/en/", "block"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), ("http://a.net/de?/de/", "a.net", "/de", None, "allow"), ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "allow"),
        ("http://h?a/b", "h", "", None, "allow"), ("http://h#a/b", "h", "", None, "allow"), (None, "", "", None, "allow"), ("com/en/", "", "", None, "allow"), ("http://x.org/EN/", "x.org", "/EN/", None, "allow"), ("a://b://c.org/es/", "b:", "//c.org/es/", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    r = urlfilter.judge_urls(pages, urlfilter.rules_frame(spark, queries.URL_RULES)).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


# -- 3


def test_edits_count_like_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    raw = open(path, "rb").read()
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counter, rng = tokencount.Counter(raw, public_tokenizers.PATTERN), random.Random(5)
    make = lambda n: "".join(rng.choices("ab e'slt ll re 've\n  \t0123é!?.,  日", k=n))
    for _ in range(400):
        text = make(rng.choice([0, 1, 5, 30, 300, 3000]))
        tree = tokencount.TokenTree(counter, text)
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 20, 400]))
            new = make(rng.choice([0, 1, 2, 8, 600]))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text and tree.n_tokens == len(whole.encode_ordinary(text))


def test_an_edit_recounts_its_surroundings_only():
    raw = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    tree = tokencount.TokenTree(tokencount.Counter(raw, public_tokenizers.PATTERN), words(random.Random(1), 5000))
    tree.edit(9000, 9003, "zz")
    assert tree.recounted < 400


@pytest.mark.parametrize("pattern", [r"\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+", r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"])
def test_edits_count_like_whole_texts_with_patterns_that_look_through_space(pattern):
    raw = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    counter, rng = tokencount.Counter(raw, pattern), random.Random(6)
    make = lambda n: "".join(rng.choices(["a", "b's", " ", " " * 20, "\n", "!", "1", "\r\n"], k=n))
    tree = tokencount.TokenTree(counter, "\n" + " " * 200 + "x")
    tree.edit(201, 202, "\n")
    assert [p for leaf in tree.leaves for p in leaf] == counter.cut("\n" + " " * 200 + "\n")
    for _ in range(300):
        text = make(rng.choice([0, 1, 5, 60, 300]))
        tree = tokencount.TokenTree(counter, text)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.choice([0, 0, 1, 30])), make(rng.choice([0, 1, 3]))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert [p for leaf in tree.leaves for p in leaf] == counter.cut(text)


def test_patterns_that_look_behind_are_refused():
    with pytest.raises(ValueError):
        tokencount.Counter(b"", r"(?<=a)b|.")


def test_one_worker_counts_by_several_patterns(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "abc def", None)], "doc_id long, text string, edits array<struct<start int, stop int, text string>>").coalesce(1)
    counts = [tokencount.count_tokens(df, path, p).first()["n_tokens"] for p in (public_tokenizers.PATTERN, r"(?s:.)", public_tokenizers.PATTERN)]
    assert counts == [counts[0], 7, counts[0]] and counts[0] < 7


def test_token_counts(spark, docs, texts):
    import tiktoken

    raw = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = tokencount.count_tokens(queries.standard_edits(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_text=True).collect()
    for r in out:
        assert r["n_tokens"] == len(whole.encode_ordinary(texts[r["doc_id"]])) and r["n_tokens_edited"] == len(whole.encode_ordinary(r["edited_text"]))
        assert r["edited_text"].endswith(" end")


# -- 4


def plain_chunks(b: bytes) -> list[tuple[int, int]]:
    h, start, out = 0, 0, []
    for i, c in enumerate(b):
        h = ((h << 1) + int(cdc.GEAR[c])) & 0xFFFFFFFF
        n = i + 1 - start
        if (h >> (32 - cdc.ZERO_BITS) == 0 and n >= cdc.LEAST) or n == cdc.MOST:
            out.append((start, i + 1))
            start = i + 1
    return out + ([(start, len(b))] if start < len(b) else [])


def in_runs(shared: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of shared chunks, those in runs of neighbours with LEAST_RUN bytes."""
    runs = []
    for a, e in shared:
        if runs and runs[-1][-1][1] == a:
            runs[-1].append((a, e))
        else:
            runs.append([(a, e)])
    return [x for r in runs if r[-1][1] - r[0][0] >= cdc.LEAST_RUN for x in r]


def test_chunks(spark, docs, texts):
    bodies = {i: t.encode() for i, t in texts.items()}
    cuts = {i: plain_chunks(b) for i, b in bodies.items()}
    first, count = {}, Counter()
    for i in sorted(bodies):
        for a, e in cuts[i]:
            count[bodies[i][a:e]] += 1
            first.setdefault(bodies[i][a:e], (i, a))
    some = 0
    for r in cdc.dedup_chunks(docs).collect():
        i = r["doc_id"]
        shared = in_runs([(a, e) for a, e in cuts[i] if count[bodies[i][a:e]] > 1])
        gone = [(a, e) for a, e in shared if first[bodies[i][a:e]] != (i, a)]
        some += len(gone)
        assert (r["n_chunks"], r["n_shared"], r["shared_bytes"]) == (len(cuts[i]), len(shared), sum(e - a for a, e in shared))
        assert ([(s["lo"], s["hi"]) for s in r["spans"]], r["n_removed_chunks"], r["n_removed"]) == (gone, len(gone), sum(e - a for a, e in gone))
    assert some


def test_passages_are_found_behind_other_texts(spark):
    rng = random.Random(8)
    passages = [words(rng, 51) for _ in range(200)]
    rows = [(2 * i + k, f"{words(rng, rng.randint(5, 90))} {p} {words(rng, rng.randint(5, 90))}", "s") for i, p in enumerate(passages) for k in (0, 1)]
    rows += [(1000 + i, words(rng, 150), "s") for i in range(40)]
    phrase = words(rng, 10)  # too short for a passage
    rows += [(2000 + i, f"{words(rng, 40)} {phrase} {words(rng, 40)}", "s") for i in range(40)]
    out = {r["doc_id"]: r for r in cdc.dedup_chunks(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert sum(out[i]["n_shared"] > 0 for i in range(400)) >= 360  # words of this fixture are shorter than those of prose
    assert all(r["n_shared"] == 0 for i, r in out.items() if i >= 1000)


# -- 5


def test_quality(spark):
    rng = random.Random(9)
    menu = "home about contact login"
    rows = [(i, f"{menu} {'#' * (i % 3)}\n{words(rng, 30)}\n{words(rng, 4)}", "h") for i in range(40)]
    rows += [(100 + i, "\n".join([menu, "terms of use and privacy notice", "all rights reserved by the owner"]) + f"\n{words(rng, 2)}", "h") for i in range(30)]
    rows += [(200, " ".join(["spam spam eggs ham toast"] * 8), "k"), (201, None, "k"), (202, "a\n a\na\na b", "k")]
    out = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i]["kept"] and out[i]["n_removed_words"] in (4, 0) for i in range(40))
    assert not any(out[100 + i]["kept"] for i in range(30)) and not out[100]["base_failed"]
    assert out[200]["n_repeat_words"] == 40 and out[200]["base_failed"] and out[201]["n_words"] == 0 and out[202]["n_dup_lines"] == 1
    assert out[1]["n_symbols"] == 1 and out[201]["base_failed"]


def test_common_lines_are_removed(spark):
    rng = random.Random(19)
    rows = [(i, f" Home  ABOUT\n\n{words(rng, 9)}\nhome about\t\nown line {i}\n", "h") for i in range(30)]
    rows += [(100 + i, f"home about\n{words(rng, 3)}", None) for i in range(3)] + [(200, None, "h"), (1, rows[1][1], "h")]
    out = quality.strip_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    hosts, seen = Counter(r[2] for r in rows), Counter()
    bare = lambda x: " ".join(x.lower().split())
    for _, t, h in rows:
        seen.update({(h, bare(x)) for x in (t or "").split("\n") if x.split()})
    over = {k for k, n in seen.items() if n > quality.LINE_DOCS and n > quality.LINE_SHARE * hosts[k[0]]}
    want = [(i, "\n".join(x for x in (t or "").split("\n") if (h, bare(x)) not in over)) for i, t, h in rows]
    assert over and sorted((r["doc_id"], r["kept_text"]) for r in out) == sorted(want)


def test_repeated_words(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 40))), "s") for i in range(150)]
    for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        w = rows[r["doc_id"]][1].split()
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        assert r["n_repeat_words"] == len({j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


# -- 6


def plain_removal(bodies: dict, length: int) -> dict:
    count = Counter(b[i : i + length] for b in bodies.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in bodies.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[k] = (len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_difference_cover():
    for period in (16, 64, 100):
        cover = set(suffix.difference_cover(period))
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def odd_texts() -> dict:
    rng = random.Random(11)
    shared = [words(rng, n) for n in (90, 200, 70)]
    period = {500: "ab " * 400, 501: "x" + "ab " * 300, 502: "z" * 1500, 503: words(rng, 100)}
    mixed = {}
    for i in range(60):
        s = rng.choice(shared)
        a = rng.randint(0, len(s) // 2)
        part = s[a : a + rng.randint(300, 900)]
        if rng.random() < 0.5:
            k = rng.randrange(len(part))
            part = part[:k] + "Q" + part[k + 1 :]
        mixed[i] = f"{words(rng, rng.randint(0, 40))} {part} {words(rng, rng.randint(0, 40))}"
    return mixed | period


#: Every bound, and one low enough that these texts go beyond it.
LOW = [suffix.Limits(), suffix.Limits(crowd=2), suffix.Limits(crowd=6, block=2000), suffix.Limits(block=2000), suffix.Limits(stretch=1000), suffix.Limits(stretch=700, block=1, crowd=1)]


@pytest.mark.parametrize("limits", LOW)
def test_substrings(spark, docs, texts, limits):
    every = {**{1000 + i: t for i, t in texts.items()}, **odd_texts()}
    want = plain_removal({i: t.encode() for i, t in every.items()}, 400)
    df = spark.createDataFrame([(i, t) for i, t in every.items()], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(df, with_text=True, limits=limits).collect()}
    assert got == want


@pytest.mark.parametrize("stretch", [8_000_000, 600])
def test_shared_passages_are_told(spark, stretch):
    every = odd_texts()
    bodies = {i: t.encode() for i, t in every.items()}
    holders, lines = {}, {}
    for i, b in bodies.items():
        for k in range(len(b) - suffix.PASSAGE_GRAM + 1):
            holders.setdefault(b[k : k + suffix.PASSAGE_GRAM], set()).add(i)
        lines[i] = {b[k : k + suffix.PASSAGE] for k in range(len(b) - suffix.PASSAGE + 1)}
    df = spark.createDataFrame([(i, t) for i, t in every.items()], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["n_shared_grams"] for r in suffix.remove_repeats(df, limits=suffix.Limits(stretch=stretch)).collect()}
    assert set(got) == set(every) and any(n == 0 for n in got.values())
    for i, b in bodies.items():
        hash_of = dict(zip(suffix._grams(np.frombuffer(b, np.uint8), suffix.PASSAGE_GRAM).tolist()[: max(0, len(b) - suffix.PASSAGE_GRAM + 1)], range(len(b))))
        least = set()
        low = (1 << suffix.PLACE_BITS) - 1
        order = {k: h & ~low for h, k in hash_of.items()}
        if len(hash_of) == len(b) - suffix.PASSAGE_GRAM + 1:  # no gram twice in the text: the smallest hash is that of one place
            least = {min(range(k, k + suffix.PASSAGE - suffix.PASSAGE_GRAM + 1), key=lambda p: (order[p], p)) for k in range(len(b) - suffix.PASSAGE + 1)}
            assert got[i] <= sum(len(holders[b[p : p + suffix.PASSAGE_GRAM]]) > 1 for p in least)
        if any(lines[i] & lines[j] for j in lines if j != i):
            assert got[i] > 0
        if not any(len(holders[b[k : k + suffix.PASSAGE_GRAM]]) > 1 for k in range(len(b) - suffix.PASSAGE_GRAM + 1)):
            assert got[i] == 0


# -- 7


def plain_fingerprint(text: str, n: int) -> int:
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups_of(ids, linked) -> dict:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("crowd", [None, 20])
def test_simhash(spark, docs, texts, monkeypatch, crowd):
    if crowd:
        monkeypatch.setattr(simhash, "CROWD", crowd)
    fps = {i: plain_fingerprint(t, 4) for i, t in texts.items()}
    ids = sorted(fps)
    want = groups_of(ids, [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4])
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.group_near(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in ids}


def test_fingerprints_of_very_long_texts(spark):
    text = words(random.Random(21), simhash.STRIDE + 5000)
    assert simhash.fingerprint(text.encode(), 4) == plain_fingerprint(text, 4)


def test_forest_and_divisions():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(1, 7))))) for b in base[:90] for _ in range(5)]
    x = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if int(x[i] ^ x[j]).bit_count() <= 4]
    for lanes in (1, 3):
        u, v = simhash.forest(np.repeat(x[:, None], lanes, axis=1), 4 * lanes)
        assert groups_of(range(len(x)), pairs) == groups_of(range(len(x)), zip(u.tolist(), v.tolist())) and len(u) < len(x)
    for blocks, agree in ((5, 1), (6, 2), (7, 3)):
        masks = simhash._masks(blocks, agree)
        assert all(any(int(x[i] ^ x[j]) & m == 0 for m in masks) for i, j in pairs)
    assert [simhash._division(n, 4) for n in (10, 10**7, 10**9)] == [(5, 1), (5, 1) if 10**7 / 2**12 <= simhash.BUCKET else (6, 2), (6, 2) if 10**9 / 2**21 <= simhash.BUCKET else (7, 3)]


def test_components(spark):
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    want = groups_of({x for e in edges for x in e}, edges)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: r for i, r in want.items() if i != r}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_similar_texts_meet(spark):
    rng = random.Random(13)
    rows, pairs = [], []
    for i in range(60):
        w = words(rng, 250).split()
        edited = list(w)
        for k in rng.sample(range(0, 250, 13), rng.randint(0, 4)):
            edited[k] = "changed"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(edited))]
    rows += [(1000 + i, words(rng, 250)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.group_similar(df).collect()}
    grams = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    pairs = [i for i in range(60) if len(grams[2 * i] & grams[2 * i + 1]) >= 0.8 * len(grams[2 * i] | grams[2 * i + 1])]
    assert len(pairs) > 40 and sum(got[2 * i] == got[2 * i + 1] for i in pairs) >= 0.95 * len(pairs)
    assert all(got[1000 + i] == 1000 + i for i in range(60))
    kept = {r["doc_id"] for r in simhash.drop_near(df).collect()}
    assert kept == set(got.values())


def near_pairs(rng: random.Random, n: int, low: float, high: float, size: int) -> list[tuple[str, str]]:
    """Pairs of texts of so many words whose 5-word shingles have a Jaccard similarity of low or more and under high."""
    out = []
    while len(out) < n:
        w = words(rng, size).split()
        edited = list(w)
        for k in rng.sample(range(size), max(1, round(size * rng.uniform(0.02, 0.05)))):
            edited[k] = "changed"
        a, b = (set(zip(*(x[k:] for k in range(5)))) for x in (w, edited))
        if low <= len(a & b) / len(a | b) < high:
            out.append((" ".join(w), " ".join(edited)))
    return out


@pytest.mark.parametrize("parts", [False, True])
def test_all_pairs_at_the_similarity_meet(spark, monkeypatch, parts):
    if parts:
        monkeypatch.setattr(simhash, "PART_SHINGLES", 200)
        monkeypatch.setattr(simhash, "CROWD", 20)
    rng = random.Random(14)
    pairs = near_pairs(rng, 150, 0.8, 0.82, 250) + near_pairs(rng, 50, 0.8, 0.85, 60)
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.group_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_no_pair_below_the_similarity_is_linked(spark):
    rng = random.Random(15)
    pairs = near_pairs(rng, 150, 0.68, 0.8, 250) + near_pairs(rng, 100, 0.8, 0.9, 250)
    for _ in range(50):  # 8 words, the last one changed: 0.6
        w = words(rng, 7)
        pairs.append((f"{w} one", f"{w} two"))
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    grams = {i: set(zip(*(t.lower().split()[k:] for k in range(5)))) for i, t in rows}
    ids = sorted(grams)
    want = groups_of(ids, [(a, b) for a in ids for b in ids if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8])
    kept = simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == set(want.values())


# -- 8


def test_index_keeps_what_it_has_seen(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = {r["doc_id"]: r for r in exact.dedup_exact(frame([(1, "A b"), (2, "a B"), (3, "c")]), path, "one").collect()}
    assert [first[i]["kept"] for i in (1, 2, 3)] == [False, True, True] and first[1]["keep_id"] == 2 and first[1]["group_size"] == 2
    second = {r["doc_id"]: r["kept"] for r in exact.dedup_exact(frame([(3, "c"), (9, "a b"), (10, "d"), (11, "D")]), path, "two").collect()}
    assert second == {3: False, 9: False, 10: False, 11: True}
    again = {r["doc_id"]: r["kept"] for r in exact.dedup_exact(frame([(3, "c"), (9, "a b"), (10, "d"), (11, "D")]), path, "two").collect()}
    assert again == second
    assert sorted(r["text"] for r in exact.drop_exact(frame([(1, "e"), (2, "E"), (3, "d")]), path, "three").collect()) == ["E"]


def test_an_index_keeps_its_own_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert exact.dedup_exact(df, path, "one").where("kept").count() == 2000
    table = exact.DigestIndex(spark, path, 99).table
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("3", "8", "32"):  # sessions with settings and catalogs of their own
        spark.sql(f"DROP TABLE {table}")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert exact.DigestIndex(spark, path, int(partitions)).buckets == int(before)
        assert exact.dedup_exact(df, path, f"again {partitions}").where("kept").count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        exact.DigestIndex(spark, path, 4, "string")
    spark.range(3).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError):
        exact.DigestIndex(spark, f"file://{tmp_path}/other", 4)


def test_only_a_to_z_are_folded(spark):
    rows = [(1, "ÄA"), (2, "äA"), (3, "Äa"), (4, "İ"), (5, "i̇")]
    kept = {r["doc_id"]: r["kept"] for r in exact.dedup_exact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: False, 2: True, 3: True, 4: True, 5: True}


# -- 9


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    model = trees.Boosted(trees=40).fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.97
    at, rate = trees.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(rate) >= 0).all() and (np.diff(at) >= 0).all() and 0 < rate.min() and rate.max() < 1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    toxic, found = out["toxic"] == 1, out["predicted"] == 1
    assert (toxic & found).sum() / toxic.sum() > 0.6 and (toxic & found).sum() / found.sum() > 0.8
    assert out["score"].between(0, 1).all()


def plain_features(text: str, learned: dict) -> list[float]:
    raw = text.encode("utf-8", "replace")
    tokens = text.lower().split()
    if not tokens:
        return [0.0] * len(toxicity.FEATURES)
    n, size = len(tokens), len(raw)
    bare = [t.strip(toxicity._EDGE) for t in tokens]
    lexicon = [w in toxicity.LEXICON for w in bare]
    weight = [max([learned.get(w + "$", 0.0), *(learned.get(w[:k], 0.0) for k in (4, 5, 6, 7, 8) if len(w) > k)]) if w else 0.0 for w in bare]
    hits = [a or b > 0 for a, b in zip(lexicon, weight)]
    second = [w in toxicity.SECOND for w in bare]
    near = sum(h and any(second[j] for j in range(max(0, i - 5), min(n, i + 6))) for i, h in enumerate(hits))
    mixed, i = [], 0
    letter = lambda c: "a" <= c <= "z" or "A" <= c <= "Z"
    flat = raw.decode("latin-1")
    while i < len(flat):  # runs of letters joined by digits and signs
        if not letter(flat[i]):
            i += 1
            continue
        parts, j = 1, i
        while j < len(flat) and letter(flat[j]):
            j += 1
        while True:
            k = j
            while k < len(flat) and flat[k] in "0123456789@$!*|._-":
                k += 1
            m = k
            while m < len(flat) and letter(flat[m]):
                m += 1
            if k == j or m == k:
                break
            parts, j = parts + 1, m
        if parts > 1:
            mixed.append(flat[i:j])
        i = j
    clear = ["".join(c for c in x.lower().translate(toxicity.LEET) if "a" <= c <= "z") for x in mixed]
    share = lambda found: sum(found(b) for b in raw) / size
    used = [w for w in weight if w]
    return [
        sum(lexicon) / n, float(sum(lexicon)), float(sum(lexicon[:50])), len(used) / n, float(len(used)), sum(used) / n, max(used, default=0.0), float(near), sum(second) / n if any(hits) else 0.0,
        share(lambda b: 65 <= b <= 90), sum(len(t) > 2 and t.isupper() for t in text.split()) / n, share(lambda b: chr(b) in "!\"'(),-./:;?"), share(lambda b: chr(b) in "!?"), share(lambda b: chr(b) in "#$%&*+<=>@[\\]^_`{|}~"),
        share(lambda b: 48 <= b <= 57), len(mixed) / n, float(sum(c in toxicity.LEXICON for c in clear)), np.log1p(n), np.log1p(size), size / n, len(set(tokens)) / n, text.count("\n") / n, share(lambda b: b > 127),
    ]


def plain_stems(rows: list[tuple], halves: set) -> dict:
    """Of (half, toxic, text): weights of the stems that tell toxic rows of these halves."""
    every, hits, misses, n = Counter(), Counter(), Counter(), Counter()
    for half, toxic, text in rows:
        found = set()
        for w in {w for x in text.lower().split() if (w := x.strip(toxicity._EDGE))}:
            found |= {w + "$", *(w[:k] for k in (4, 5, 6, 7, 8) if len(w) > k)}
        every.update(found if toxic else ())
        if half in halves:
            n[toxic] += 1
            (hits if toxic else misses).update(found)
    odds = {s: np.log((hits[s] + 0.5) / (n[1] + 1.0)) - np.log((misses[s] + 0.5) / (n[0] + 1.0)) for s in hits if every[s] >= toxicity.LEAST_ROWS}
    good = [s for s, o in odds.items() if o >= toxicity.LEAST_ODDS and hits[s] >= max(toxicity.LEAST_ROWS, toxicity.LEAST_SHARE * n[1])]
    return {s: odds[s] for s in sorted(good, key=lambda s: (-odds[s] * hits[s] ** 0.5, s))[: toxicity.MAX_STEMS]}


def test_scores_are_those_of_plain_features_and_a_plain_fit(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, sf).collect()}
    half = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.concat(F.lit("half"), F.col("doc_id").cast("string"))), F.lit(2)).alias("h")).collect()}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    import zlib

    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in text}
    rows = sorted((str(r["doc_id"]), half[r["doc_id"]], r["toxic"], text[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in text and not out[r["doc_id"]])
    stems = {k: plain_stems([r[1:] for r in rows], h) for k, h in ((0, {0}), (1, {1}), (2, {0, 1}))}
    x = np.array([plain_features(t, stems[1 - h]) for _, h, _, t in rows])
    y = np.array([float(r[2]) for r in rows])
    cross = np.zeros(len(y))
    for k in range(5):
        own = np.arange(len(y)) % 5 == k
        cross[own] = trees.Boosted().fit(x[~own], y[~own]).score(x[own])
    at, rate = trees.isotonic(cross, y)
    raw = trees.Boosted().fit(x, y).score(np.array([plain_features(t, stems[2]) for t in text.values()]))
    want = 0.999 * np.interp(raw, at, rate) + 0.001 / (1 + np.exp(-raw))
    assert len(got) == len(text)
    for i, p in zip(text, want):
        assert got[i]["held_out"] == out[i] and got[i]["score"] == pytest.approx(p, abs=1e-6) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_held_out_labels_decide_nothing(spark):
    sf = SMALL
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()} for x in (labels, turned.repartition(3)))
    assert a == b


# -- 10


def test_pieces_are_the_library_s(spark, texts):
    import sentencepiece

    model = queries.piece_model()
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    own, rng = piece.read_model(model), random.Random(14)
    coder = piece.PieceCoder(own)
    odd = ["", " ", "  ", "a  b   c ", "\n", "a\n b", " \n ", "x▁y", "▁", "▁▁▁", "<s></s><unk><0x41>", "\x00", "😀😀 a", "A" * 500, "あ漢字", "a " * 50, "ᚠᚢ", "\ufeffabc", "é", "word.\n\nNext", " " * 40 + "x" + " " * 17]
    odd += ["".join(rng.choices("ab etionst\n ▁é😀zQ0123456789.,!?-_    ᚠ́", k=rng.randint(1, 60))) for _ in range(800)]
    odd += ["".join(rng.choice(own["pieces"][259:]).replace("▁", rng.choice([" ", "▁", ""])) for _ in range(rng.randint(1, 12))) for _ in range(800)]
    for t in [*odd, *list(texts.values())[:60]]:
        ids, decoded = coder.encode(t)
        want = library.encode(t, add_eos=True)
        assert ids == " ".join(map(str, want)) and decoded == library.decode(want), t[:80]


def test_backtracking_is_the_merge_order():
    coder, rng = piece.PieceCoder(piece.read_model(queries.piece_model())), random.Random(15)
    for _ in range(1500):
        t = "".join(rng.choices("aeiouthnrs", k=rng.randint(1, 25)))
        assert coder._backtrack(t) == coder.merged(t)


def test_encode_and_digest_agree(spark, docs):
    a = {r["doc_id"]: r for r in piece.encode_pieces(docs, queries.piece_model()).collect()}
    for r in piece.digest_pieces(docs, queries.piece_model()).collect():
        ids = a[r["doc_id"]]["ids"]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(a[r["doc_id"]]["decoded"].encode()).hexdigest()
