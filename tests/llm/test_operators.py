"""Every operator against a plain version on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import html_extract, neighbours, quality, toxicity
from millrace.llm.common import stored
from millrace.llm.decontaminate import leaks, normalised, without_leaks
from millrace.llm.mixing import fill_budget, mix_sources, mixed_documents
from millrace.llm.pii import find_pii, pii_digest
from millrace.llm.repeats import without_repeats
from millrace.llm.sharding import read_map, shard_documents
from millrace.llm.similarity import frequent_shingles, meetings, one_per_group, similar_components
from millrace.llm.words import shingle_sets
from millrace.session import scratch_path

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """A documents table with a column whose name operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, DOCS)
    names = ["size", "text_hash", "pii", "score", "key", "n", "_hash", "group", "slot", "copies"]
    return df.withColumns({n: F.lit("x") for n in names}).repartition(3)


def some_documents(seed=1, n=60):
    rng = random.Random(seed)
    words = [a + b for a in "bcdfg" for b in "aeiou"]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.25:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.55 and rng.choice(rows)[1]:
            text = (rng.choice(rows)[1] or "a b").split(" ")
            text[rng.randrange(len(text))] = rng.choice(words)
            text = " ".join(text)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 2, 5, 30, 80))))
        rows.append((i, text, rng.choice(["a", "b", "z", "é", None])))
    rows += [(None, rows[3][1], "a"), (None, None, None), (1000, None, "b"), (1001, "", "b")]
    rows += [(7, "same id another text", "a"), rows[5], rows[5], (2000, "É  é\t A b\n" * 3000, "z")]
    return rows


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# PII

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _confirmed(kind, found):
    figures = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "phone":
        return 9 <= len(figures) <= 15
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(figures)):
            n = int(c) * (1 + i % 2)
            total += n - 9 if n > 9 else n
        return 12 <= len(figures) <= 19 and total % 10 == 0
    return True


def _base(text):
    text = text or ""
    return sorted(
        (m.start(), i, m.end(), k)
        for i, (k, p) in enumerate(PII.items())
        for m in re.finditer(p, text)
        if _confirmed(k, m.group())
    )


def test_pii_base_spans(spark):
    rng = random.Random(3)
    parts = ["a.b+c@x-y.org", "@", "u@h.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "300.1.1.1", "é", "\n",
             "0000255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+49 (0) 30 12345",
             "+1-", "+12 345 678 901 2", "+1", " ", "x", "-", ".", "\U0001f600", "12", "378282246310005", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "a" * 60_000 + "@", "1" * 60_000, "a@b" + ".c" * 30_000, "+" * 5000 + "1" * 20, "\x01\x02"]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in pii_digest(documents(spark, rows)).collect()}
    assert len(found) == len(rows)
    for i, t, _ in rows:
        want = _base(t)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert found[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (t or "")[:90]
        counts = Counter(k for *_, k in want)
        assert [found[i][f"n_{k}"] for k in PII] == [counts[k] for k in PII]
        assert set(joined.split(",")) - {""} <= set(found[i].spans.split(","))


def test_pii_further_kinds_and_context(spark):
    rows = [
        (1, "IBAN GB82 WEST 1234 5698 7654 32 today", "a"), (2, "IBAN GB83WEST12345698765432", "a"),
        (3, "ssn 219-09-9999.", "a"), (4, "part 219-09-9999.", "a"), (5, "ssn 000-09-9999", "a"),
        (6, "server 10.0.0.1 and release 10.0.0.1", "a"),
    ]
    docs = documents(spark, rows)
    spans = {r.doc_id: r.pii for r in find_pii(docs).collect()}
    kinds = {i: [s.kind for s in v] for i, v in spans.items()}
    assert kinds == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: [], 6: ["ip", "ip"]}
    assert spans[6][0].score > spans[6][1].score
    assert spans[1][0].value == rows[0][1][5:32]
    assert find_pii(docs).columns.count("pii") == 1


# Jaccard join


def _sets(rows, k):
    out = []
    for _, t, _ in rows:
        w = [x.lower() for x in WORD.findall((t or "").encode())]
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        out.append(frozenset(grams or ([tuple(w)] if w else [])))
    return out


def _groups(sets, num, den):
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (2, 60), (5, 80)])
def test_similar_components(spark, k, num):
    rows = some_documents(seed=k, n=150)
    sets = _sets(rows, k)
    groups = _groups(sets, num, 100)
    least = {}
    for (i, *_), g in zip(rows, groups, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted(
        (
            (i, len(s), least.get(g) if s else i)
            for (i, *_), s, g in zip(rows, sets, groups, strict=True)
        ),
        key=repr,
    )
    got = similar_components(documents(spark, rows), k, num, 100)
    assert collected(got, "doc_id", "n_shingles", "component_id") == want


def test_shingles_spread_thinly_over_tasks_are_known_as_frequent(spark):
    texts = [f"common words here own{i} more{i} last{i}" for i in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    assert max(r[0] for r in docs.groupBy(F.spark_partition_id()).count().select("count").collect()) < 8
    shared = shingle_sets([b"common words here"], 3)[0]
    assert frequent_shingles(docs, 3).tolist() == shared.tolist()


def test_no_more_than_the_most_frequent_are_known(spark):
    words = [f"a{j} b{j} c{j}" for j in range(5)]
    texts = [w for j, w in enumerate(words) for _ in range(10 + j // 2)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    known = [shingle_sets([w.encode()], 3)[0][0] for w in words]  # 10, 10, 11, 11, 12 times
    for most in (1, 2, 4):
        got = frequent_shingles(docs, 3, most)
        assert len(got) <= most and got[-1] == known[4]
    assert set(frequent_shingles(docs, 3, 9).tolist()) == set(known)


def test_sets_that_share_a_run_of_lists_meet_once(spark):
    rows = []
    for i in (1, 2):
        last = None
        for place in range(10):
            key = 100 * i if place == 5 else place  # a list of its own parts two runs
            rows.append((key, i, 200, place, True, place, last, i))
            last = key
    kind = "key long, set_id long, n long, place long, short boolean, before long, last long, component long"
    lists = spark.createDataFrame(rows, kind)
    assert [tuple(r) for r in meetings(lists, 90, 100).collect()] == [(1, 2)] * 2


def test_links_between_texts_that_share_runs_of_lists_are_found(spark):
    rng = random.Random(11)
    rows = []
    for family in range(6):
        base = [f"w{family}x{j}" for j in range(150)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(1, 5)):  # each edit costs three of 148 shingles
                words[rng.randrange(150)] = f"own{rng.randrange(40)}"
            rows.append((len(rows), " ".join(words), "a"))
    sets = _sets(rows, 3)
    groups = _groups(sets, 90, 100)
    assert 6 < len(set(groups)) < len(rows)
    least = {}
    for (i, *_), g in zip(rows, groups, strict=True):
        least[g] = min(least.get(g, i), i)
    want = [(i, len(s), least[g]) for (i, *_), s, g in zip(rows, sets, groups, strict=True)]
    docs = documents(spark, rows).repartition(5)
    got = similar_components(docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_one_row_of_each_group_stays(spark):
    rows = some_documents(seed=4, n=100)
    sets = _sets(rows, 5)
    groups = _groups(sets, 80, 100)
    docs = documents(spark, rows)
    kept = one_per_group(docs, 5, 80, 100)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    by_group = defaultdict(list)
    for (i, t, _), s, g in zip(rows, sets, groups, strict=True):
        by_group[g if s else None].append((i, t))
    empty = by_group.pop(None)
    assert len(left) == len(by_group) + len(empty)
    assert not Counter(empty) - Counter(left)
    for members in by_group.values():
        stay = [x for x in left if x in members]
        assert len(stay) == 1
        ids = [i for i, _ in members if i is not None]
        assert stay[0][0] == (min(ids) if ids else None)


# Repeats


def _without_repeats(rows, length):
    first = {}
    texts = [((t or "").encode(), 1 << 62 if i is None else i, i) for i, t, _ in rows]
    for b, o, _ in texts:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, o), o)
    out = []
    for b, o, i in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < o:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [12, 50])
def test_repeats(spark, length):
    rng = random.Random(length)
    base = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    rows = []
    for i in range(90):
        text = "".join(
            rng.choice(base)[rng.randint(0, 5) :]
            if rng.random() < 0.7
            else "".join(rng.choice("abcé") for _ in range(rng.randint(0, 20)))
            for _ in range(rng.randint(0, 5))
        )
        rows.append((rng.choice([i, i, i, 3, None]), text if rng.random() < 0.95 else None, "a"))
    rows += [(500, "a" * 400, "a"), (501, "a" * 60, "a"), (2, "\0" * 80, "a"), (9, "\0" * 70 + "a", "a")]
    rows += some_documents(n=30)[:-1]
    got = without_repeats(documents(spark, rows), length, length // 2 - 1)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert collected(got, *columns) == _without_repeats(rows, length)


# Sharding


def test_shards_are_even_and_numbered_without_gaps(spark):
    rows = some_documents(seed=6, n=400)
    got = [r.asDict() for r in shard_documents(documents(spark, rows), shards=4, slots=256).collect()]
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(
            range(sum(r["shard"] == s for r in got))
        )
    small = [r for r in got if r["size"] < 1000]
    per = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert sorted(per)[2] - sorted(per)[0] <= max(r["size"] for r in small)
    again = shard_documents(documents(spark, rows).repartition(7), shards=4, slots=256)
    assert Counter(map(str, got)) == Counter(str(r.asDict()) for r in again.collect())


def test_a_stored_slot_map_is_edited_version_by_version(spark):
    rows = some_documents(seed=6, n=400)
    docs, path = documents(spark, rows), scratch_path(spark, "map")
    assert read_map(spark, path) is None
    shard_of = []
    for shards in (4, 5, 5, 3):
        got = shard_documents(docs, shards, 256, path)
        kept = {r.virtual_slot: r for r in read_map(spark, path).collect()}
        assert len(kept) == 256 and {r.version for r in kept.values()} == {len(shard_of) + 2}
        shard_of.append({s: r.shard for s, r in kept.items()})
        if len(shard_of) > 1:
            assert {s: r.previous_shard for s, r in kept.items()} == shard_of[-2]
        for r in got.collect():
            assert kept[r.virtual_slot].shard == r.shard and r.map_version == len(shard_of) + 1
        assert sum(r.rows for r in kept.values()) == len(rows)
    first, grown, again, shrunk = shard_of
    moved = [s for s in first if first[s] != grown[s]]
    assert moved and all(grown[s] == 4 for s in moved) and again == grown
    assert set(shrunk.values()) == {0, 1, 2}
    old = {r.virtual_slot: r.shard for r in read_map(spark, path, 2).collect()}
    assert old == first
    with pytest.raises(ValueError, match="256 slots"):
        shard_documents(docs, 4, 128, path)
    with pytest.raises(ValueError, match="no version 9"):
        read_map(spark, path, 9)


# Pipeline


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty texts, copies, a leak and a clashing column, from stage to stage."""
    import corpus_pipeline

    rng = random.Random(20)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "window", "garden"]
    good = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(60)) for _ in range(40)]
    junk = ["$$$ click !!! " * 20 + str(i) for i in range(20)]
    item = " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(20))
    rows = [(i, t, "a" if i % 3 else "b") for i, t in enumerate(good)]
    rows += [(100 + i, t, "a") for i, t in enumerate(junk)]
    rows += [(200 + i, good[0], "c") for i in range(5)] + [(300, good[1] + " tail", None)]
    rows += [(400, " ".join(good[2].split()[:40]) + " " + item, "b"), (500, None, "a"), (501, "", None)]
    rows += [(None, good[5], "b"), (7, good[7], "b")]
    docs = documents(spark, rows)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    left, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stored(stage(spark, left, folder), name)
        assert left.columns[: len(DOCS.split(","))] == [c.split()[0] for c in DOCS.split(",")]
        seen[name] = Counter(r.doc_id for r in left.collect())
    assert set(range(40)) <= set(seen["quality"]) and not set(range(100, 120)) & set(seen["quality"])
    unique = seen["near_duplicates"]
    assert not set(range(201, 205)) & set(unique) and 300 not in unique and unique[7] <= 1
    assert set(range(40)) - {0, 1, 5, 7} <= set(unique)
    assert 400 in unique and 400 not in seen["decontamination"]
    assert set(seen["decontamination"]) == set(unique) - {400}
    assert set(seen["mixing"]) <= set(seen["decontamination"])
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == seen["mixing"]
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


# Mixing


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {s: 0.0 for s in names}, set(names)
    left = float(sum(sizes.values()))
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += weight[s] * share
        left = sum(max(0, target[s] - 3 * sizes[s]) for s in open_)
        full = {s for s in open_ if target[s] >= 3 * sizes[s]}
        for s in full:
            target[s] = 3.0 * sizes[s]
        open_ -= full
    return target


def test_mix_meets_its_targets(spark):
    rows = [(i, t, s) for i, t, s in some_documents(seed=7, n=300)]
    rows += [(5000 + i, "w " * (i % 3), "hot") for i in range(400)] + [(6000, "only one", "zz")]
    docs = documents(spark, rows)
    got = [r.asDict() for r in mix_sources(docs).collect()]
    size = {}
    want = Counter()
    for i, t, s in rows:
        n = len(WORD.findall((t or "").encode()))
        size[s] = size.get(s, 0) + n
        want[i, s, n] += 1
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == want
    targets = _targets(size)
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        if s == "z":  # one document is longer than the target: all others, three times
            assert taken[s] == 3 * sum(r["size"] for r in got if r["source"] == s and r["size"] < 12_000)
        else:
            assert abs(taken[s] - t) <= 3, (s, taken[s], t)
    again = mix_sources(documents(spark, rows).repartition(5)).collect()
    assert Counter(map(str, got)) == Counter(str(r.asDict()) for r in again)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    plain = {(r["doc_id"], r["text_hash"]): r["copies"] for r in sorted(got, key=lambda r: r["copies"])}
    rows_out = mixed.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "h")
    times = Counter((r[0], r[1]) for r in rows_out.collect())
    n_rows = Counter((r["doc_id"], r["text_hash"]) for r in got)
    assert times == Counter({k: c * n_rows[k] for k, c in plain.items() if c})


# Decontamination


def test_leaks_against_the_edit_table(spark):
    from tests.llm.test_words_and_parts import _edit_distance

    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma,", "d"]) for _ in range(9))) for i in range(8)]
    items += [(8, None), (9, ""), (10, "!!"), (11, items[0][1].upper()), (None, items[1][1])]
    rows = []
    for i in range(60):
        _, t = items[i % 8]
        t = list(t)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice("abcz ")
        rows.append((i, "before it " + "".join(t) + " after", "a"))
    rows += [(None, items[2][1], "a"), (61, None, "a"), (62, "", "a"), (63, "clean text", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    want = []
    for d, t, _ in rows:
        for i, item in items:
            p = normalised(item)
            if p:
                e = _edit_distance(p, normalised(t))
                if e <= int(0.07 * len(p)):
                    want.append((d, i, e))
    for size in (4_000_000, 100):  # in one block, and in many
        got = leaks(docs, bench, block_bytes=size)
        assert collected(got, "doc_id", "item_id", "distance") == sorted(want, key=repr)
    clean = without_leaks(docs, bench)
    dirty = {d for d, *_ in want}
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted(
        (d for d, *_ in rows if d not in dirty), key=repr
    )


# Models


def labelled(spark, seed=9):
    rng = random.Random(seed)
    words = [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("n", "r", "")]
    rows, marks = [], []
    for i in range(900):
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["idiot,", "Scum", "worthless."]))
        text = " ".join(text) if good else " ".join(f"{w.upper()}!!" for w in text)
        rows.append((i, text, "a"))
        marks.append((i, int(good), int(toxic)))
    marks += [(None, 1, 1), (3, None, None), (5, 1, 1), (90_000, 0, 0)]
    rows += [(None, rows[0][1], "a"), (1000, None, "a"), (1001, "", "b"), rows[1], rows[1]]
    return rows, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


def test_quality_on_rows_held_out(spark):
    rows, labels, marks = labelled(spark)
    docs = documents(spark, rows)
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in marks[:900]}
    right = []
    for r in got:
        part = None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 3
        assert r.held_out == (part == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if part == 1 and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert np.mean(right) > 0.97
    good = quality.good_documents(docs, labels)
    assert good.columns == docs.columns
    yes = sorted((r.doc_id for r in got if r.predicted), key=repr)
    assert sorted((r.doc_id for r in good.select("doc_id").collect()), key=repr) == yes
    none = quality.score_quality(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_kernel_features_approximate_the_gaussian_kernel(spark):
    rows, labels, _ = labelled(spark)
    stats = quality.document_stats(documents(spark, rows[:300]), ["doc_id"]).persist()
    model = quality.train(stats, labels)
    x = np.array([r.stats for r in stats.collect()])
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    f = model.fourier(x)[:, 1 + z.shape[1] :]
    apart = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    gamma = 2 * quality.WIDTH / z.shape[1]
    assert np.abs(f @ f.T - np.exp(-gamma * apart)).mean() < 0.06


def test_toxicity_finds_toxic_texts_and_leaves_others(spark):
    rows, labels, marks = labelled(spark)
    got = toxicity.score_toxicity(documents(spark, rows), labels).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in marks[:900]}
    by_id = {r.doc_id: r for r in got}
    assert np.mean([by_id[i].toxic == bool(t) for i, t in truth.items()]) > 0.98
    assert not by_id[1000].toxic and not by_id[1001].toxic
    none = toxicity.score_toxicity(documents(spark, rows[:5]), labels.where("toxic = 0")).collect()
    assert not any(r.toxic for r in none)


def test_toxicity_learns_from_few_toxic_rows(spark):
    rng = random.Random(3)
    words = [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("n", "r", "")]

    def text(i):
        out = [rng.choice(words) for _ in range(25)]
        if i % 8 == 0:
            out.insert(5, "scum" if i % 16 else "moron")
        return " ".join(out)

    truth = {i: i % 8 == 0 for i in range(280)}
    docs = documents(spark, [(i, text(i), "a") for i in truth])
    marks = [(i, 1, int(truth[i])) for i in range(87)]  # 11 are toxic
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert np.mean([r.toxic == truth[r.doc_id] for r in got if r.doc_id >= 87]) > 0.97


def test_toxicity_learns_hundreds_of_words(spark):
    rng = random.Random(4)
    common = [f"{i:03d}w" for i in range(900)]
    bad = [f"{i:03d}x" for i in range(450)]

    def text(word):
        return " ".join([*(rng.choice(common) for _ in range(20)), *word])

    rows = [(i, text([bad[i // 2 % 450]] if i % 2 else []), "a") for i in range(9000)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(8000)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(documents(spark, rows), labels).collect()
    assert np.mean([r.toxic == bool(r.doc_id % 2) for r in got if r.doc_id >= 8000]) > 0.97


def test_beginnings_stay_only_where_they_add_texts(spark):
    texts = [(i, w, 1) for i, w in enumerate(["disgusting a", "walked b", "walking c"] * 4)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, y int")
    got = {r.word: r.toxic for r in toxicity.word_counts(rows).collect()}
    hashes = toxicity._hashed([b"walkxxx"])[0].view(np.int64)  # the word, then its first 4 bytes
    whole = [np.int64(np.uint64(toxicity._word(w)).view(np.int64)) for w in ("disgusting", "walked", "walking")]
    assert got == {**{int(w): 4 for w in whole}, int(hashes[1]): 8,
                   **{int(np.uint64(toxicity._word(w)).view(np.int64)): 4 for w in "abc"}}


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=(700, 8)), 1).astype(np.float32)
    x[100:400] = x[0]  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] * 8, [1.0] * 7, []]
    rows += [(2000 + 20 * i, v) for i, v in enumerate(odd)] + [(None, [9.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit(1))
    asked = vectors.where("vec_id % 20 = 0")
    found = defaultdict(dict)
    for r in neighbours.search(vectors, asked, 20).collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    wide, hits, want_all = x.astype(np.float64), 0, 0
    assert set(found) == set(range(0, 700, 20))
    for q in found:
        scores = (wide * wide[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:20]
        got = [found[q][r] for r in range(1, 21)]
        assert got == sorted(got, key=lambda t: (-t[1], t[0]))
        assert all(abs(scores[i] - s) < 1e-12 for i, s in got)
        hits += len({i for i, _ in got} & set(order))
        want_all += 20
    assert hits / want_all >= 0.9


def test_articles_of_a_table(spark):
    from tests.llm.test_words_and_parts import PAGE

    rows = [
        (i, f"http://x/{i}", PAGE.replace("{open}", "<article>").replace("{close}", "</article>").replace("{i}", str(i)))
        for i in range(50)
    ]
    rows += [(50, None, None), (None, "u", ""), (51, "v", "no tags"), rows[3]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = html_extract.extract_articles(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    for r in got.collect():
        if r.page_id is not None and r.page_id < 50:
            i = r.page_id
            assert r.text == f"Title {i}\n\nFirst & {i} line.\n\nSecond part, {i}."
        elif r.page_id != 51:
            assert r.text == ""
        assert r.n_chars == len(r.text)


def test_articles_where_pages_are_long_or_rarely_marked(spark):
    from tests.llm.test_words_and_parts import PAGE

    menu = "<ul class=menu>" + "".join(f"<li><a href=/{i}>Entry {i}</a>" for i in range(70)) + "</ul>"

    def page(i, name):
        return PAGE.replace("{open}", f"{menu}<{name}>").replace("{close}", f"</{name}>").replace("{i}", str(i))

    rows = [(i, "u", page(i, "article")) for i in range(40)]
    rows += [(i, "u", f"<p>Nothing is marked here, {i}.</p>") for i in range(100, 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_articles(pages, 30).collect()}
    for i in range(40):
        assert got[i] == f"Title {i}\n\nFirst & {i} line.\n\nSecond part, {i}."


def test_empty_tables(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [
        pii_digest(docs), similar_components(docs, 3, 90, 100), one_per_group(docs), without_repeats(docs),
        shard_documents(docs), mix_sources(docs), mixed_documents(docs), leaks(docs, bench),
        without_leaks(docs, bench), quality.score_quality(docs, labels), quality.good_documents(docs, labels),
        toxicity.score_toxicity(docs, labels), neighbours.search(vectors, vectors),
        html_extract.extract_articles(pages),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_one_word_items_match_whole_words_only(spark):
    docs = documents(spark, [(1, "another day", "s"), (2, "say No. again", "s"), (3, None, "s")])
    items = spark.createDataFrame([(5, "No.")], "item_id long, text string")
    assert [tuple(r) for r in leaks(docs, items).collect()] == [(2, 5, 0, 6)]
    assert sorted(r.doc_id for r in without_leaks(docs, items).collect()) == [1, 3]


def test_mix_closes_budgets_beside_a_very_long_text():
    lengths = np.array([*range(1, 8001), 1_000_000])
    counts = np.ones(len(lengths), dtype=np.int64)
    budget = 5_000_003
    take = fill_budget(lengths, counts, budget)
    assert (take * lengths).sum() == budget and (take <= counts).all() and (take >= 0).all()


def test_passages_in_long_stretches_of_one_sign(spark):
    for period in ("-", "- ", "ab", "x-=", "-" * 9 + "+"):
        stretch = (period * 3000)[:3000]
        texts = [
            (1, f"begin {stretch} end of the first", "s"),
            (2, f"other words {stretch} and more", "s"),
            (3, f"{stretch[:70]}|{stretch[:49]}|{stretch[1:150]}", "s"),
        ]
        got = {r.doc_id: r for r in without_repeats(documents(spark, texts)).collect()}
        raws = {i: t.encode() for i, t, _ in texts}
        for i, raw in raws.items():
            earlier = {r[a : a + 50] for j, r in raws.items() if j < i for a in range(len(r) - 49)}
            gone = np.zeros(len(raw), dtype=bool)
            for a in range(len(raw) - 49):
                if raw[a : a + 50] in earlier:
                    gone[a : a + 50] = True
            kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone])
            assert got[i].n_removed == gone.sum(), (period, i)
            assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_anchors_of_a_stretch_of_one_sign_stay_few():
    from millrace.llm.repeats import find_anchors

    _, pos, _ = find_anchors([b"-" * 5_000_000], 50, 20)
    assert len(pos) < 5_000_000 / 30


def test_pii_of_thousands_of_matches(spark):
    text = " ".join(f"write to user{i}@mail{i}.example.org" for i in range(16_000))
    got = pii_digest(documents(spark, [(1, text, "s")])).head()
    assert got.n_email == 16_000
    spans = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"user\S+", text))
    assert got.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
