"""Pieces that run without Spark, against plain versions."""

from __future__ import annotations

import random
import re
from itertools import pairwise, product

import numpy as np
import pytest

from millrace.llm.decontaminate import Matcher, least_distance, masks, normalised, pieces
from millrace.llm.html_extract import FEATURES, Field, fit_field, leaf_blocks, main_text, training_pages
from millrace.llm.mixing import fill_budget
from millrace.llm.neighbours import fit_router, nearest
from millrace.llm.quality import pool_adjacent, text_stats
from millrace.llm.repeats import find_anchors, maximal_repeats, prefix_intervals
from millrace.llm.sharding import first_map, rebalance
from millrace.llm.toxicity import fit_chain, logistic
from millrace.llm.words import hash_words, shingle_sets


def test_word_hashes_tell_words_apart_and_fold_case():
    texts = ["", "One two\tTHREE", "  ", "one TWO three four", "x" * 5000, "é É e"]
    words, of, *_ = hash_words([t.encode() for t in texts])
    plain = [(i, w.lower()) for i, t in enumerate(texts) for w in re.findall(rb"[^\x20\x09-\x0d]+", t.encode())]
    assert of.tolist() == [i for i, _ in plain]
    by_hash = {}
    for h, (_, w) in zip(words.tolist(), plain, strict=True):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len({w for _, w in plain})


def test_shingles_of_short_texts_are_their_whole_sequence():
    a, b, c, d, e = shingle_sets([b"", b"a b", b"A  b", b"a b c", b"a b c d a b c"], 3)
    assert len(a) == 0 and len(b) == 1 and b.tolist() == c.tolist()
    assert len(d) == 1 and d[0] != b[0]
    assert len(e) == 5 - 1 and d[0] in e


def _edit_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_bit_parallel_distance_against_the_table():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert least_distance(masks(item), len(item), text)[0] == _edit_distance(item, text)


def test_matcher_finds_what_brute_force_finds():
    rng = random.Random(2)
    items = [(i, normalised("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 50))))) for i in range(25)]
    for _ in range(40):
        text = ""
        for _ in range(5):
            _, t = rng.choice(items)
            t = list(t)
            for _ in range(rng.randint(0, 5)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("abcd")
            text += "".join(t) + "xyz"
        text = normalised(text)
        want = {
            (i, _edit_distance(f" {t} ", f" {text} ")) for i, t in items
            if t and _edit_distance(f" {t} ", f" {text} ") <= int(0.1 * len(t))
        }
        assert {(i, d) for i, d, _ in Matcher(items, 0.1).matches(text)} == want
    assert "".join(p for _, p in pieces("abcdefghij", 3)) == "abcdefghij"


def test_budget_is_met_exactly_where_it_can_be():
    rng = np.random.default_rng(3)
    for _ in range(200):
        lengths = np.unique(rng.integers(0, 300, rng.integers(1, 30)))
        counts = rng.integers(1, 9, len(lengths))
        whole = int((lengths * counts).sum())
        budget = int(rng.integers(0, whole + 1))
        take = fill_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        sums = 1
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            for _ in range(c):
                sums |= sums << n
        assert int((take * lengths).sum()) == max(b for b in range(budget + 1) if sums >> b & 1)


def test_isotonic_levels_rise_and_keep_the_mean():
    rng = np.random.default_rng(4)
    y, n = rng.random(50), rng.integers(1, 9, 50)
    out = pool_adjacent(y, n)
    assert (np.diff(out) >= 0).all()
    assert np.isclose((out * n).sum(), (y * n).sum())


def test_statistics_do_not_depend_on_neighbours():
    texts = [b"", b"One two.\nTwo", b"!!! ###", b" ", "é ".encode() * 40, b"x" * 3000]
    together = text_stats(texts)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], text_stats([t])[0])


def test_prefix_intervals_against_all_pairs():
    rng = random.Random(5)
    for _ in range(200):
        common = [rng.randint(0, 4) for _ in range(rng.randint(0, 9))]
        n = len(common) + 1
        want = set()
        for a, b in product(range(n), range(n)):
            if a < b:
                v = min(common[a:b])
                if v >= 1 and (a == 0 or common[a - 1] < v) and (b == n - 1 or common[b] < v):
                    want.add((v, a, b))
        got = list(prefix_intervals(common, 1))
        assert len(got) == len(set(got)) and set(got) == want


def test_maximal_repeats_have_all_occurrences_and_differ_on_the_left():
    rng = random.Random(6)
    rows = [[rng.choice("ab") for _ in range(10)] for _ in range(14)]
    rows.sort(key=lambda r: r[4:])
    text = np.array([[ord(c) for c in r] for r in rows], dtype=np.uint8)
    right, left = text[:, 4:], text[:, :4][:, ::-1]
    full = np.full(len(rows), 6), np.full(len(rows), 4)
    seen = set()
    for members, back, forward in maximal_repeats(right, left, *full, 5):
        strings = {"".join(rows[m][4 - back : 4 + forward]) for m in members}
        assert len(strings) == 1 and back + forward >= 5
        of = [i for i, r in enumerate(rows) if "".join(r[4 - back : 4 + forward]) in strings]
        assert sorted(members.tolist()) == of
        assert back == 4 or len({rows[m][3 - back] for m in members}) > 1
        seen.add((back, forward, strings.pop()))
    for i, a in enumerate(rows):  # every long enough match of a pair is inside a repeat
        for b in rows[:i]:
            f = next((k for k in range(6) if a[4 + k] != b[4 + k]), 6)
            p = next((k for k in range(4) if a[3 - k] != b[3 - k]), 4)
            if f and f + p >= 5:
                assert (p, f, "".join(a[4 - p : 4 + f])) in seen


def test_equal_passages_have_equal_anchors():
    rng = random.Random(7)
    passage = bytes(rng.randrange(97, 100) for _ in range(40))
    texts = [bytes(rng.randrange(97, 100) for _ in range(rng.randint(0, 30))) + passage for _ in range(5)]
    of, pos, h = find_anchors(texts, 20, 8)
    at = [len(t) - len(passage) for t in texts]
    inside = [
        {(p - at[i], k) for o, p, k in zip(of, pos, h.tolist(), strict=True) if o == i and p >= at[i]}
        for i in range(5)
    ]
    deep = [{x for x in s if 12 <= x[0] <= 20} for s in inside]
    assert deep[0] and all(d == deep[0] for d in deep)


def test_growing_a_slot_map_moves_slots_only_into_the_new_shard():
    rng = random.Random(8)
    loads = {s: rng.randint(1, 100) for s in range(512)}
    before = rebalance(first_map(512, 8), loads, 8)
    after = rebalance(before, loads, 9)
    moved = [s for s in loads if before[s] != after[s]]
    assert moved and all(after[s] == 8 for s in moved)
    totals = [sum(loads[s] for s in loads if after[s] == i) for i in range(9)]
    assert max(totals) - min(totals) <= 100


def test_slots_over_an_even_share_get_a_shard_of_their_own():
    loads = {s: 10 for s in range(64)} | {1: 5000, 2: 3000}
    placed = rebalance(first_map(64, 4), loads, 4)
    totals = [sum(loads[s] for s in loads if placed[s] == i) for i in range(4)]
    assert placed[1] != placed[2] and sorted(totals) == [310, 310, 3000, 5000]
    fewer = rebalance(placed, loads, 3)
    assert set(fewer.values()) == {0, 1, 2} and fewer[1] != fewer[2]
    assert sorted(sum(loads[s] for s in loads if fewer[s] == i) for i in range(3)) == [620, 3000, 5000]
    assert rebalance(fewer, loads, 3) == fewer
    assert rebalance(first_map(4, 2), {}, 2) == first_map(4, 2)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p title='x>hello</p></article>", "hello"),
        ('<article><p title="a>b">hello</p></article>', "hello"),
        ("<article><p class=it's>one</p><p>it's</p></article>", "one\n\nit's"),
        ("<article><p>one</p><p title='", "one"),
    ],
)
def test_quotes_that_are_not_closed_are_no_text(page, text):
    assert "\n\n".join(b.text for b in leaf_blocks(page)) == text


def test_viterbi_finds_the_best_of_all_labellings():
    rng = np.random.default_rng(12)
    for n in range(1, 9):
        field = Field(rng.normal(size=len(FEATURES)), rng.normal(size=(2, 2)) * 2)
        features = [rng.choice(len(FEATURES), 3, replace=False).tolist() for _ in range(n)]

        def value(labels, field=field, features=features):
            own = sum(field.weights[f].sum() for f, y in zip(features, labels, strict=True) if y)
            return own + sum(field.pairs[a, b] for a, b in pairwise(labels))

        best = max(product((0, 1), repeat=n), key=value)
        assert tuple(field.decode(features)) == best


def test_chain_feeds_earlier_categories_to_later_ones():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2, (600, 4)).astype(float)
    first = x[:, 0]
    model = fit_chain(np.arange(4, dtype=np.uint64), x, np.stack([first, first], axis=1))
    assert model.weights[1][-1] > 0.5 and len(model.weights[1]) == len(model.weights[0]) + 1
    assert logistic(x[:0], first[:0])[0] < 0
    assert logistic(x, np.ones(600))[0] > 0


def test_router_finds_neighbours_it_has_not_seen():
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 2400)] + 0.2 * rng.normal(size=(2400, 16))
    router = fit_router(x, 10)
    new = centres[rng.integers(0, 20, 200)] + 0.2 * rng.normal(size=(200, 16))
    true = nearest(new, x, 10, np.full(200, len(x) - 1))
    place, visited = router.best(x, 1)[:, 0], router.best(new, router.visits)
    found = np.mean([(np.isin(place[t], v)).mean() for t, v in zip(true, visited, strict=True)])
    assert found >= 0.9 and router.visits < len(router.b2)


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>x='</p>'</script></head>"
    "<body><nav><ul><li><a href=/a>Menu</a><li><a href=/b>More</a></ul></nav>{open}<h1>Title {i}</h1>"
    "<p><b>First  &amp; {i}<br>line.<p>Second\n part, {i}.</p>{close}<!-- no --><footer>&copy; {i}"
    "</footer></body></html>"
)


def test_blocks_and_articles_of_untidy_pages():
    def page(i, name="article"):
        return PAGE.replace("{open}", f"<{name}>").replace("{close}", f"</{name}>").replace("{i}", str(i))

    blocks = leaf_blocks(page(1))
    assert [b.text for b in blocks] == [
        "T", "Menu", "More", "Title 1", "First & 1 line.", "Second part, 1.", "\N{COPYRIGHT SIGN} 1",
    ]
    field = fit_field(training_pages(page(i) for i in range(40)))
    want = "Title 7\n\nFirst & 7 line.\n\nSecond part, 7."
    assert main_text(field, page(7)) == want
    assert main_text(field, page(7, "div")) == want
    for odd in ("", "<", "<p", "</p></p>", "text only", "<b>" * 3000, "<script>", "&am", "\0<p>\0"):
        leaf_blocks(odd)
    assert main_text(field, "") == ""
    assert fit_field([]).decode([[0]]) == [0]
