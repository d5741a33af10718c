"""Operators that SQL can't express, against plain versions of what they compute."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from medialens.llm import bpe, chat, decontamination, minhash, queries, sharding, substrings, toxicity
from medialens.llm.queries import table, tokenizer_path
from medialens.llm.words import hash_words


def docs_of(spark, sf_dir):
    return [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def normal_words(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or "").lower())


# words


@pytest.mark.parametrize("letters", [True, False])
def test_word_hashes_tell_words_apart(letters):
    texts = ["Hello, wörld hello", None, "", "  ", "a" * 5000 + " b", "ÉA éa\tx\x0by", "1 22 1", "don't"]
    words = hash_words(pa.array(texts), letters_only=letters)
    pattern = r"[0-9A-Za-z\x80-\U0010ffff]+" if letters else r"[^\x20\x09-\x0d]+"
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, (t or "").lower())]
    assert words.row.tolist() == [i for i, _ in want]
    names = {}
    assert all(names.setdefault(w, h) == h for (_, w), h in zip(want, words.hash.tolist(), strict=True))
    assert len(set(names.values())) == len(names)
    assert words.first.tolist() == [sum(i < k for i, _ in want) for k in range(len(texts) + 1)]


# substring dedup


def pieces(text):
    """(start, words) of the sentences of a text, long ones cut at the lowest hash of each window."""
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    hashes = hash_words(pa.array([text]), lower=False).hash.tolist()
    begins = {i for i in range(len(found)) if i == 0 or re.search(r"[.!?\n]", text[found[i - 1][1] : found[i][0]])}
    cuts = set(begins)
    for i in range(len(found) - substrings.WINDOW + 1):
        window = range(i, i + substrings.WINDOW)
        if not begins & set(window):
            cuts.add(min(window, key=lambda k: (hashes[k], -k)))
    out = []
    for i, (start, _, word) in enumerate(found):
        if i in cuts:
            out.append((start, []))
        out[-1][1].append(word)
    return out


def brute_substrings(rows):
    """(sentences, removed ones, characters left, text left) of each document of sorted (doc_id, text) rows."""
    cut = {d: pieces(t) for d, t in rows}
    first, covered = {}, defaultdict(set)
    enough = lambda ps: len(ps) >= substrings.SPAN and sum(len(ws) for _, ws in ps) >= substrings.MIN_WORDS
    for d, _ in rows:
        p = cut[d]
        runs = [(i, j) for i in range(len(p)) if (j := next((j for j in range(i + 1, len(p) + 1) if enough(p[i:j])), None))]
        if runs and runs[-1][1] < len(p):
            runs = sorted([*runs, (runs[-1][0], len(p))])
        for i, j in runs:
            words = tuple(w for _, ws in p[i:j] for w in ws)
            if first.setdefault(words, (d, i)) != (d, i):
                covered[d] |= set(range(i, j))
    want = {}
    for d, t in rows:
        starts = [s for s, _ in cut[d]]
        left = t
        if covered[d]:
            ends = [*starts[1:], len(t)]
            left = ("" if 0 in covered[d] else t[: starts[0]]) + "".join(t[a:b] for i, (a, b) in enumerate(zip(starts, ends, strict=True)) if i not in covered[d])
            left = left.rstrip()
        want[d] = (len(starts), len(covered[d]), len(left), left)
    return want


def test_substring_dedup(spark, sf_dir):
    want = brute_substrings(sorted(docs_of(spark, sf_dir)))
    got = {r[0]: tuple(r)[1:] for r in queries.op1_substring_dedup(spark, sf_dir).collect()}
    assert got == want
    assert any(v[1] for v in want.values())


def test_passages_without_any_stop_are_found(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    words = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for k in range(400):
        passage = words(51)
        rows += [(2 * k, f"{words(30 + k % 40)} {passage} {words(20)}"), (2 * k + 1, f"{words(41)} {passage} {words(33)}")]
    out = {r.doc_id: r.n_removed for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert all(out[2 * k + 1] for k in range(400)) and not any(out[2 * k] for k in range(400))


def test_long_repeated_passages_go_and_others_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    text = lambda n: ". ".join(" ".join(word() for _ in range(rng.randint(4, 15))) for _ in range(n)) + "."
    passage = text(8)
    rows = [(i, f"{text(4)} {word()} {passage if i % 2 else ''} {text(3)}") for i in range(20)]
    out = {r.doc_id: r for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    inner = passage.split(". ")[2]
    assert [i for i in out if inner in out[i].text] == [1]
    assert all(out[i].n_removed == 0 and out[i].text == t for i, t in rows if i % 2 == 0 or i == 1)


# sharding


def test_lookup_table_is_balanced_and_stable():
    names = [f"s{i}" for i in range(10)]
    full = sharding.lookup_table(names, 1009)
    assert set(Counter(full).values()) <= {100, 101}
    less = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 9)
    assert moved < 0.1 * 1009
    heavy = Counter(sharding.lookup_table(["a", "b"], 997, [3, 1]))
    assert abs(heavy[0] - 3 * heavy[1]) <= 3
    for bad in ((["a", "a"], 7), ([], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


# chat


def test_chat_escapes_are_reversible():
    rng = random.Random(1)
    parts = [*chat.CONTROLS, chat.TURN, chat.END, "\\", "<", "[", "|", "ok", " ", "/", ">"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROLS)


def test_prefix_tree_shares_turns_and_reads_back():
    rng = random.Random(2)
    convs = {f"c{i}": [(rng.choice(["user", "assistant"]), rng.choice("ab")) for _ in range(rng.randint(1, 5))] for i in range(60)}
    convs["d"] = convs["c0"]
    pack = chat.build_pack(list(convs.items()))
    prefixes = {tuple(t[:k]) for t in convs.values() for k in range(1, len(t) + 1)}
    assert len(pack["nodes"]) == len(prefixes)
    ends = dict(pack["ends"])
    for key, turns in convs.items():
        parent, start, end, position, *_, context = pack["nodes"][ends[key]]
        text = "".join(pack["text"][a:b] for a, b in context) + pack["text"][start:end]
        assert chat.parse(text) == turns
        assert position == sum(b - a for a, b in context)
    assert all(p < i for i, (p, *_) in enumerate(pack["nodes"]))


def test_a_hot_first_turn_is_dealt_into_packs(spark):
    rows = [(i, t, "user" if t == 0 else "assistant", "hello" if t == 0 else f"answer {i}") for i in range(300) for t in (0, 1)]
    convs, packs = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), max_conversations=50)
    made = packs.collect()
    assert 6 >= len(made) > 1 and max(len(p.ends) for p in made) < 150
    assert sum(len(p.nodes) for p in made) == 300 + len(made)
    assert chat.digests(convs, packs).count() == 300


# decontamination


def brute_leaks(rows, items):
    """(doc_id, item_id) of all leaks."""
    items, want = [(i, normal_words(t)) for i, t in items], set()
    for d, t in rows:
        w = normal_words(t)
        for i, item in items:
            shared = set(item)
            need = min(13, len(item))
            if not item or sum(x in shared for x in w) < 0.8 * need:
                continue
            for start in range(1 - len(item), len(w)):
                eq = [0 <= start + k < len(w) and w[start + k] == item[k] for k in range(len(item))]
                if sum(eq) < 0.8 * need:
                    continue
                if any(sum(eq[a:b]) * 100 >= 80 * (b - a) for a in range(len(eq)) for b in range(a + need, len(eq) + 1)):
                    want.add((d, i))
                    break
    return want


def items_of(spark, sf_dir):
    return [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]


def test_leaks_against_all_alignments(spark, sf_dir):
    want = brute_leaks(docs_of(spark, sf_dir), items_of(spark, sf_dir))
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, sf_dir).collect()}
    assert got == want and want


def test_longest_stretch():
    rng = np.random.default_rng(0)
    for _ in range(300):
        eq = rng.random(rng.integers(1, 40)) < 0.8
        a, b = decontamination.longest_stretch(eq)
        best = max((j - i for i in range(len(eq)) for j in range(i + 1, len(eq) + 1) if eq[i] and eq[j - 1] and eq[i:j].mean() >= 0.8 - 1e-12), default=0)
        assert b - a == best


def test_substitutions_are_tolerated(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    item = [word() for _ in range(40)]
    changed = [word() if k % 5 == 4 else w for k, w in enumerate(item)]
    rows = [(1, " ".join([word() for _ in range(30)] + changed + [word()])), (2, " ".join(word() for _ in range(80))), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (8, None), (7, "too short")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()] == [(1, 9)]
    assert [(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench, block_words=10).collect()] == [(1, 9)]
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, bench).collect()) == [2, 3]


def accepted_patterns(n):
    """All ways in which the words of a stretch of n agree (1) to 80 %, the first and last words included."""
    for k in range(n // 5 + 1):
        for changed in itertools.combinations(range(n), k):
            yield [int(i not in changed) for i in range(n)]


def test_every_accepted_pattern_has_a_seed():
    seeds = [decontamination._offsets(m) for m in decontamination.MASKS]
    assert all(len(s) == 8 and max(s) > 7 for s in seeds)
    for n in range(1, 13):
        for p in accepted_patterns(n):
            assert any(all(p[k] for k in kept) for kept in decontamination.whole_masks(n)), p
    bits = [(sum(1 << o for o in s), s[-1]) for s in seeds]
    for n in range(13, 26):  # a stretch of 26 or more has a part of 13 to 25 words that counts
        for k in range(n // 5 + 1):
            for changed in itertools.combinations(range(n), k):
                p = (1 << n) - 1 - sum(1 << i for i in changed)
                assert any((p >> i) & s == s for s, last in bits for i in range(n - last)), changed


def test_items_with_any_substituted_words_leak(spark):
    word = "w{}x{}".format
    items = [(n, " ".join(word(n, i) for i in range(n))) for n in range(1, 17)]
    texts, want = [], []
    for n, _ in items:
        for k, p in enumerate(accepted_patterns(n)):
            middle = " ".join(word(n, i) if equal else "other" for i, equal in enumerate(p))
            texts += ["before it " + middle + " after", middle.removeprefix("other ").removesuffix(" other")] if k % 3 == 0 else ["before it " + middle + " after"]
            want += [n] * (len(texts) - len(want))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == list(enumerate(want))


def test_short_items_against_all_alignments(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))) for i in range(200)]
    items = [(i, " ".join(rng.choice("abcd") for _ in range(i % 16))) for i in range(64)]
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_leaks(docs, items) and len(found) == len({(r.doc_id, r.item_id) for r in found})
    for r in found:
        equal = [a == b for a, b in zip(dict(docs)[r.doc_id].split()[r.doc_start : r.doc_start + r.n_overlap], dict(items)[r.item_id].split()[r.item_start :], strict=False)]
        assert sum(equal) == r.n_equal and len(equal) == r.n_overlap and equal[0] and equal[-1]


def test_frequent_words_make_few_candidates():
    """Texts of a few hundred frequent words: seeds of eight words meet hardly ever where nothing leaks."""
    rng = np.random.default_rng(2)
    likely = 1 / np.arange(1, 301)
    draw = lambda n: " ".join(f"w{k}" for k in rng.choice(300, n, p=likely / likely.sum()))
    texts, items = [draw(600) for _ in range(300)], [draw(60) for _ in range(300)]
    import pyarrow as pa

    seen = []
    for side in (texts, items):
        words = decontamination.hash_words(pa.array(side))
        windows = decontamination._windows(words)
        seen.append([dict.fromkeys(zip(h.tolist(), words.row[at].tolist(), strict=True)) for h, at in map(windows, map(decontamination._offsets, decontamination.MASKS))])
    pairs = set()
    for left, right in zip(*seen, strict=True):
        owners = {}
        for h, item in right:
            owners.setdefault(h, []).append(item)
        pairs |= {(row, item) for h, row in left for item in owners.get(h, ())}
    assert len(pairs) < 0.02 * len(texts) * len(items)


def test_texts_that_repeat_themselves_are_compared_in_bounded_time(spark):
    import tracemalloc
    from unittest import mock

    one, two = np.full(8000, 5, np.uint64), np.full(800, 5, np.uint64)
    places = [(np.arange(7997), np.arange(797)), (np.arange(7995), np.arange(795))]
    other = two.copy()
    other[::3] = 6  # never enough equal words, so all diagonals are tried
    tracemalloc.start()
    with mock.patch.object(decontamination, "longest_stretch", wraps=decontamination.longest_stretch) as measured, mock.patch.object(decontamination, "reaching", wraps=decontamination.reaching) as blocks:
        assert decontamination.best_overlap(one, two, places) == (800, 800, 0, 0)
        assert decontamination.best_overlap(one, other, places) is None
    assert measured.call_count == 1 and blocks.call_count < 20 and tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
    rows = spark.createDataFrame([(1, "same " * 8000)], "doc_id long, text string")
    item = spark.createDataFrame([(2, "same " * 800)], "item_id long, text string")
    assert [tuple(r) for r in decontamination.leaks(rows, item).collect()] == [(1, 2, 800, 800, 0, 0)]


# toxicity


def test_held_out_toxicity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    bad = ["grumbleface", "snotwaffle", "grumblehead"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        words = [word() for _ in range(rng.randint(30, 120))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "s", "ish", "ly"])
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score(docs, model).collect()
    right = [r.predicted == int(r.doc_id % 6 == 0) for r in out if r.held_out]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def exact_ratios(texts, labelled, asked):
    """Log-likelihood ratios of the words of the asked texts, from exact counts of (text, toxic) rows and exact numbers of the
    words that stand before a form in all texts. Words are ASCII."""
    levels, least, d = [*toxicity.STEMS, None], toxicity.MIN_COUNT, toxicity.DISCOUNT
    form = lambda w, level: w if levels[level] is None else w[: levels[level]]
    before, pairs = [defaultdict(set) for _ in levels], set()
    for t in texts:
        w = normal_words(t)
        for a, b in zip(w, w[1:], strict=False):
            pairs.add((a, b))
            for k in range(len(levels)):
                before[k][form(b, k)].add(a)
    counts, two, total = [defaultdict(lambda: [0, 0]) for _ in levels], defaultdict(lambda: [0, 0]), [0, 0]
    for t, c in labelled:
        w = normal_words(t)
        for i, x in enumerate(w):
            total[c] += 1
            for k in range(len(levels)):
                counts[k][form(x, k)][c] += 1
            if i:
                two[w[i - 1], x][c] += 1
    counts = [{x: n for x, n in of.items() if sum(n) >= least} for of in counts]
    two = {x: n for x, n in two.items() if sum(n) >= least}
    off = lambda n: max(n - d, 0.0)
    stands = lambda k, x: max(len(before[k][x]), 0.5)
    p, missing = [], []
    for k, of in enumerate(counts):
        spare = [max(1 - sum(off(n[c]) for n in of.values()) / total[c], 1e-6) for c in (0, 1)]
        missing.append(np.log(spare[1] / spare[0]))
        p.append({})
        for x, n in of.items():
            up = form(x, k - 1) if k else None
            share = min(1.0, stands(k, x) / stands(k - 1, up)) if k else stands(0, x) / len(pairs)
            p[k][x] = [off(n[c]) / total[c] + spare[c] * (p[k - 1][up][c] if k else 1.0) * share for c in (0, 1)]
    spent = defaultdict(lambda: [0.0, 0.0])
    for (a, _), n in two.items():
        for c in (0, 1):
            spent[a][c] += off(n[c]) / max(counts[-1][a][c], 1)
    back = {a: [min(1.0, max(1e-3, 1 - spent[a][c])) for c in (0, 1)] for a in counts[-1]}
    log = lambda q: np.log(q[1] / q[0])
    out = []
    for t in asked:
        w = normal_words(t)
        for i, x in enumerate(w):
            known = next((k for k in range(len(levels) - 1, -1, -1) if form(x, k) in p[k]), -1)
            ratio = (log(p[known][form(x, known)]) if known >= 0 else 0.0) + sum(missing[known + 1 :])
            if i and (w[i - 1], x) in two:
                a = w[i - 1]
                ratio = log([off(two[a, x][c]) / max(counts[-1][a][c], 1) + back[a][c] * p[-1][x][c] for c in (0, 1)])
            elif i and w[i - 1] in back:
                ratio += log(back[w[i - 1]])
            out.append(ratio)
    return np.array(out)


def test_model_against_exact_counts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 11)))
    common, bad = [word() for _ in range(150)], ["grumbleface", "snotwaffle", "grumblehead", "mean spirited"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(common) if rng.random() < 0.9 else word() for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            w += [rng.choice(bad) for _ in range(3)]
            rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    known = toxicity._labelled(docs, marks, "doc_id", "text", "toxic", toxicity.MAX_LABELLED).filter("NOT for_curve").collect()
    texts = [t for _, t in rows] + ["grumblefaces snotwaffled nothing like it"]
    want = exact_ratios([t for _, t in rows], [(r.text, r.toxic) for r in known], texts)
    got = model.word_ratios(toxicity.words_of(pa.array(texts)))
    # the model's numbers of contexts are estimates; a form that only toxic texts hold is not touched by them
    assert len(got) == len(want) and np.abs(got - want).mean() < 0.03 and np.abs(got - want).max() < 0.5
    assert np.corrcoef(got, want)[0, 1] > 0.995


def test_distinct_counts_are_near():
    rng = np.random.default_rng(1)
    for n in (3, 30, 300, 30_000):
        found = []
        for _ in range(40):
            h = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
            regs = np.zeros((1, 16), np.uint8)
            np.maximum.at(regs[0], (h & np.uint64(15)).astype(int), toxicity._rank(h))
            found.append(toxicity.estimate(regs)[0])
        assert abs(np.mean(found) / n - 1) < 0.25


def test_shared_counts_hold_all_words_of_all_texts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12)))
    vocabulary = [word() for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) for _ in range(40)] + ["once snotwaffles", None, ""]
    before, pairs = defaultdict(set), set()
    for t in texts:
        w = normal_words(t)
        for a, b in zip(w, w[1:], strict=False):
            pairs.add((a, b))
            for level, form in enumerate([*[b[:k] for k in toxicity.STEMS], b]):
                before[level, form].add(a)
    got = {(r.level, r.key): r.stands for r in toxicity.continuation_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)).collect()}
    forms = sorted(before)
    words = toxicity.words_of(pa.array([f for _, f in forms]))
    keys = [int(toxicity.keys_of(words, level)[i].view(np.int64)) for i, (level, _) in enumerate(forms)]
    assert {(level, key) for (level, _), key in zip(forms, keys, strict=True)} | {(-1, 0)} == set(got)
    ratios = [got[level, key] / len(before[level, form]) for (level, form), key in zip(forms, keys, strict=True)]
    assert abs(np.mean(ratios) - 1) < 0.1 and abs(got[-1, 0] / len(pairs) - 1) < 0.1
    assert got[toxicity.WORD, int(toxicity.keys_of(toxicity.words_of(pa.array(["snotwaffles"])), toxicity.WORD)[0].view(np.int64))] == pytest.approx(1, abs=0.1)


# near duplicates


def brute_classes(rows, threshold=0.8):
    bags = {}
    for d, t in rows:
        w = normal_words(t)
        bags[d] = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    parent = {d: d for d, _ in rows}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    first, by_shingle = {}, defaultdict(list)
    for d, t in rows:
        join(d, first.setdefault(t, d))
        for s in bags[d]:
            by_shingle[s].append(d)
    seen = set()
    for ds in by_shingle.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = sum((bags[a] & bags[b]).values())
                    if both >= threshold * (sum(bags[a].values()) + sum(bags[b].values()) - both) - 1e-9:
                        join(a, b)
    return {d: find(d) for d, _ in rows}


def test_near_duplicate_classes(spark, sf_dir):
    want = brute_classes(docs_of(spark, sf_dir))
    got = {r.doc_id: r for r in queries.op8_near_dedup(spark, sf_dir).collect()}
    assert {d: r.class_id for d, r in got.items()} == want
    assert {d for d, r in got.items() if r.kept} == set(want.values())
    assert {d: r.n_docs for d, r in got.items()} == {d: Counter(want.values())[c] for d, c in want.items()}


def test_a_large_group_of_borderline_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 6)
    monkeypatch.setattr(minhash, "CHUNK", 16)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == brute_classes(rows)
    kept = minhash.drop_near_duplicates(docs.union(docs)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute_classes(rows).values()))


def test_texts_whose_hashes_collide_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(minhash, "hash_of", lambda name: F.pmod(F.xxhash64(name), F.lit(5)))
    rows = [(i, " ".join(f"w{i % 20}x{k}" for k in range(30)) + (" more" if i >= 20 else "")) for i in range(40)]
    got = {r.doc_id: (r.class_id, r.n_docs) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i % 20, 2) for i in range(40)}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    errors = []
    for most in (1, 3, 9):
        for _ in range(60):
            a = {int(x): int(rng.integers(1, most + 1)) for x in rng.integers(0, 1 << 62, 30)}
            b = {k: c + int(rng.integers(-2, 3)) for k, c in a.items()} | {int(rng.integers(0, 1 << 62)): 2}
            b = {k: c for k, c in b.items() if c > 0}
            keys = set(a) | set(b)
            j = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
            s = minhash.signatures(np.repeat([0, 1], [len(a), len(b)]), minhash.mix(np.array([*a, *b], np.uint64)), np.array([*a.values(), *b.values()]), 2, 256)
            errors.append(((s[0] == s[1]).mean() - j) / max(1e-9, (j * (1 - j) / 256) ** 0.5))
    assert abs(np.mean(errors)) < 0.3 and 0.7 < np.std(errors) < 1.3


# bytes and pairs


def test_bpe_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r for r in queries.op9_bpe(spark, sf_dir).collect()}
    for d, text in docs_of(spark, sf_dir):
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(got[d]) == (d, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_of_odd_texts():
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(tokenizer_path()), bpe.WordBpe(tokenizer_path())
    rng = random.Random(6)
    texts = ["", " ", "x" * 3000, "ab" * 2000, "ΑΣ Σ", "İ Ǆ ß́", "a<|endoftext|>b <|startoftext|>", "<|endoftext", "don't WE'LL", "a\x1cb\x85c\u2028d", "日本 𝒳 ՘ Ᲊ", "é é"]
    texts += ["".join(rng.choice("abcdeth's 1.,<|>éÉ漢\n") for _ in range(200)) for _ in range(200)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(32, 0xD7FF)])) for _ in range(60)) for _ in range(200)]
    for t, raw in zip(texts, mine.encode_batch(texts), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids, t
        assert mine.decode(raw) == library.decode(ids, skip_special_tokens=False)


# the pipeline


def brute_quality(rows):
    """(doc_id, text left) of the (doc_id, text, source) rows that the quality rules keep."""
    white = " \t\n\x0b\x0c\r"
    words = lambda t: [w for w in re.split("[ \t-\r]+", t) if w]
    norm = lambda x: " ".join(words(x)).lower()
    holders = defaultdict(set)
    for _, t, source in rows:
        for x in t.split("\n"):
            if x.strip(white):
                holders[source, norm(x)].add(t)
    out = []
    for d, t, source in rows:
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
        lines = t.split("\n")
        gone = [bool(x.strip(white)) and len(holders[source, norm(x)]) > 20 for x in lines]
        lost = sum(len(words(x)) for x, g in zip(lines, gone, strict=True) if g)
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and 100 * lost <= 50 * len(w):
            out.append((d, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def test_pipeline_is_its_stages_one_after_another(spark, sf_dir):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows = [(r.doc_id, r.text or "", r.source) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "source").collect()]
    kept = brute_quality(sorted(rows))
    classes = brute_classes(kept)
    kept = [(d, t) for d, t in kept if classes[d] == d]
    left = brute_substrings(kept)
    kept = [(d, left[d][3]) for d, _ in kept]
    leaked = {d for d, _ in brute_leaks(kept, items_of(spark, sf_dir))}
    library = Tokenizer.from_file(tokenizer_path())
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in kept if d not in leaked}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and leaked and len(want) < len(rows)
