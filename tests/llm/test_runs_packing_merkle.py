"""Periodic runs, hierarchical packing and the Merkle manifest, against brute force."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("millrace.llm")
from millrace.llm import merkle, packing, runs  # noqa: E402
from millrace.llm.queries import QUERIES  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def all_runs(words, least, periods):
    """Every run by looking at every period; the smallest of a stretch's periods stays."""
    found, n = [], len(words)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(
        ((s, n, q) for s, n, q in found
         if not any(q > d and q % d == 0 and a <= s and a + m >= s + n for a, m, d in found)),
        key=lambda r: (r[0], r[2]),
    )


def made_words(rng, n):
    words, letters = [], rng.choice([1, 2, 3, 20])
    while len(words) < n:
        if rng.random() < 0.3:
            part = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
            words += (part * rng.randint(1, 8))[: rng.randint(1, 60)]
        else:
            words.append(rng.randrange(letters))
    return [str(w).encode() for w in words]


@pytest.mark.parametrize("least,periods", [(24, 3), (6, 2), (6, 3), (1, 2), (10, 4)])
def test_squares_and_stretches_give_all_runs(least, periods):
    rng = random.Random(least + periods)
    for _ in range(300):
        words = made_words(rng, rng.randint(0, 120))
        want = all_runs(words, least, periods)
        assert runs.squares(words, least, periods) == want
        text = b" ".join(words)
        _, got = runs.runs_of([b"other words", text, b"", text], least, periods)
        assert got == [[], want, [], want]


def test_runs_of_odd_texts(spark):
    line = "one two three "
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, line * 8), (4, line * 8), (None, "x " * 30),
        (5, "\x0bA\x0ca " + "b c " * 24 + "end"), (6, "long " * 60_000),
    ]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, runs int")
    got = {r.doc_id: r for r in runs.periodic_runs(docs).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0
    assert got[1].collapsed == "" and got[1].runs == []
    assert [tuple(r) for r in got[4].runs] == [(0, 24, 3)] and got[4].collapsed == "one two three"
    assert got[None].collapsed == "x" and got[None].n_words == 30
    assert [tuple(r) for r in got[5].runs] == [(2, 24, 1)] and got[5].collapsed == "A a b c end"
    assert [tuple(r) for r in got[6].runs] == [(0, 60_000, 1)]
    assert runs.run_digest(docs.limit(0)).count() == 0


def test_run_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want = all_runs(words, 24, 3)
        planted += bool(want)
        dropped = {i for s, m, q in want for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in want)
        best = (None,) * 4
        for s, m, q in want:
            if best[0] is None or m * best[2] > best[1] * q:
                best = (s, m, q, 1000 * m // q)
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(want), *best)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
    assert planted > 5


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_words_give_the_tokens_of_whole_texts():
    from tokenizers import Tokenizer

    path, rng = vocabulary(), random.Random(4)
    whole = Tokenizer.from_file(path)
    signs = ["a", "B", "é", "é", " ", "\n", "\x0b", " ", "\x85", "İ", "Σ", "1", "!", ".", ",",
             "'s", "<|endoftext|>", "日本", "\U0001f642", "‍", "ﬁ", "\x00", "</w>", "wordy", "ſ"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        ids = whole.encode(text, add_special_tokens=False).ids
        assert packing.token_bytes(text.encode(), path) == struct.pack(f"<{len(ids)}I", *ids)


def check_pieces(pieces, texts, path, longest=4096):
    """Every id of every document in one piece, every sequence gapless and in its window."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids, at = [*whole.encode(text or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(ids)
    unfilled = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= parts[0].tier <= longest
        unfilled += at < parts[0].tier
    assert unfilled <= 1
    steps = defaultdict(set)
    for p in pieces:
        steps[p.step_id].add(p.tier)
    assert all(len(t) == 1 for t in steps.values())


def test_packing_holds_every_id_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = QUERIES["op12_hierarchical_packing"](spark, sf_dir).collect()
    check_pieces(pieces, texts, vocabulary())


def test_packing_of_odd_tables(spark, monkeypatch):
    path = vocabulary()
    rows = [(i, None if i == 3 else "" if i == 4 else f"text {i} " * (i % 7 + 1)) for i in range(300)]
    rows.append((300, "very long " * 9_000))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tier int")
    check_pieces(packing.pack_documents(docs.repartition(40), path, 2).collect(), dict(rows), path)
    monkeypatch.setattr(packing, "REST_TASKS", 3)  # several levels of rests
    monkeypatch.setattr(packing, "BATCH_TOKENS", 500)
    check_pieces(packing.pack_documents(docs.repartition(40), path, 2).collect(), dict(rows), path)
    assert packing.pack_documents(docs.limit(0), path, 2).count() == 0
    none = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    got = packing.pack_documents(none, path, 2).collect()
    assert sorted((p.start, p.length, p.offset) for p in got) == [(0, 3, 0), (0, 3, 3)]
    with pytest.raises(ValueError):
        packing.pack_documents(docs, path, 2, (512, 4096))


def test_windows_keep_documents_whole_where_they_can():
    pool = packing.Pool()
    for doc, n in enumerate([900, 700, 300, 130, 100, 20]):
        pool.add((doc, 0, n))
    made = list(packing.windows(pool, (512, 1024)))
    assert made == [
        (1024, [(0, 0, 900), (4, 0, 100), (5, 0, 20), (3, 0, 4)]),
        (1024, [(1, 0, 700), (2, 0, 300), (3, 4, 28)]),
    ]
    assert pool.tokens == 102
    costs = [9, 1, 8, 2, 7, 3]
    steps = packing.balanced_steps(costs, 2)
    assert sorted(sum(c for c, s in zip(costs, steps, strict=True) if s == k) for k in (0, 1)) == [14, 16]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout=3):
    """The top of a tree and for each leaf what stands before and behind it, level by level."""
    paths, level = [[] for _ in leaves], [(h, [i]) for i, h in enumerate(leaves)]
    while len(level) > 1:
        above = []
        for k in range(0, len(level), fanout):
            run = level[k : k + fanout]
            for j, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(("".join(h for h, _ in run[:j]), "".join(h for h, _ in run[j + 1 :])))
            above.append((digest(*[h for h, _ in run]), [i for _, b in run for i in b]))
        level = above
    return level[0][0], paths


def plain_leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def check_manifest(docs, got):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: r[:3])
        trees[s] = plain_tree([leaf for _, _, leaf, _ in by_source[s]])
    root, upper = plain_tree([trees[s][0] for s in sources])
    want = []
    for s, up in zip(sources, upper, strict=True):
        for (_, _, leaf, row), path in zip(by_source[s], trees[s][1], strict=True):
            path = path + up
            now = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                now[4] = row[4].replace("\n", "")
            folded = plain_leaf(now)
            for before, behind in path:
                folded = digest(before, folded, behind)
            proof = digest(*[a + b for a, b in path])
            want.append((str(row[0]), leaf, trees[s][0], root, proof, folded, folded == root))
    found = [
        (str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
        for r in got.collect()
    ]
    assert sorted(found) == sorted(want)


def test_manifest_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_manifest(docs, QUERIES["op13_merkle_manifest"](spark, sf_dir))


def test_manifest_of_odd_tables(spark):
    rows = [(i, f"line {i}\nend", "hot" if i % 3 else f"s{i % 4}") for i in range(1, 60)]
    rows += [(100, None, None), (101, "", None), (None, "a\nb", "é"), (102, "x", ""), (103, "\n" * 9, "\U0001f642")]
    docs = documents(spark, rows)
    check_manifest(docs, merkle.verified_manifest(docs))
    one = documents(spark, rows[:1])
    check_manifest(one, merkle.verified_manifest(one))
    assert merkle.verified_manifest(docs.limit(0)).count() == 0
    # Repeated rows: as many leaves, each with a proof of its own that holds.
    twice = documents(spark, [(7, "a", "s")] * 5).withColumn("leaf", F.lit(1))
    found = merkle.verified_manifest(twice)
    assert found.where("verified").count() == 5 and found.select("proof_sha256").distinct().count() > 1
