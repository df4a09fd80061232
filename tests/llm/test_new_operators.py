"""The conversation trie, language-model scores and the Merkle manifest against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from settleframe.llm import listrank, maxent, merkle, prefixtrie
from settleframe.llm.textbytes import slices

TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, key string, seq string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- conversation trie


def _order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest())


def trie_by_hand(rows, rebuild=True):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(t, key=_order)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        whole[c] = own.get(base, [])[:h] + turns[h:] if rebuild else turns
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(p))))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), kids[p], leaves[p], saved[p], sha(ends)))
    return sorted(map(str, out))


def conversations(seed, n=90):
    """Conversations of few different turns, so that many share prefixes, with ties, nulls, repeats, and long ones."""
    draw = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -5, -7, 10**12, 10**12 + 3]:
        if draw.random() < 0.1:
            continue
        hot = draw.random() < 0.4
        for k in range(draw.choice([1, 2, 3, 5, 8, 12])):
            text = f"ü{k}" if hot else draw.choice(["", None, "yes", "no", "é" * 40])
            turn = None if draw.random() < 0.1 else k // 2 if draw.random() < 0.2 else k
            rows.append((c, turn, "user" if hot else draw.choice(["user", "assistant", None, ""]), text))
    rows += [(5, k, "user", f"long {k % 11}") for k in range(300)] + [(7, 1, "user", "again")] * 40
    rows += [(None, 1, "user", "x"), (None, None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], TURNS).repartition(3)


@pytest.mark.parametrize("bound,chunk,slab", [(1 << 17, 1 << 12, 1 << 16), (20, 4, 7)])
def test_trie(spark, monkeypatch, bound, chunk, slab):
    """Once as in production, and once with tiny bounds: many rounds of coin tosses, and prefixes cut into many chunks."""
    monkeypatch.setattr(listrank, "SLAB", slab)
    monkeypatch.setattr(prefixtrie, "PIECE", 3)
    rows = conversations(4)
    got = prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.turns(frame(spark, rows))), bound, chunk).collect()
    assert sorted(str(tuple(r[:8])) for r in got) == trie_by_hand(rows)
    assert sorted(x for r in got for x in (r.enter, r["leave"])) == list(range(2 * len(got)))  # the tour has every place once


def test_trie_of_conversations_as_they_are(spark):
    rows = conversations(9, 40)
    got = prefixtrie.trie(prefixtrie.as_they_are(prefixtrie.turns(frame(spark, rows)))).collect()
    assert sorted(str(tuple(r[:8])) for r in got) == trie_by_hand(rows, rebuild=False)


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(k for k in range(1, 99) if k % 5 and zlib.crc32(str(k).encode()) % 9 >= 2)
    (root,) = prefixtrie.rebuilt_trie(frame(spark, [(c, 0, "user", "x"), (c, 1, "user", "y")])).collect()
    assert tuple(root[:8]) == (c, 0, None, 1, 0, 1, 0, sha(str(c)))


def test_list_ranks_of_scattered_arcs(spark):
    draw = random.Random(2)
    arcs = draw.sample(range(10**9), 3000)
    weights = [(1, draw.randrange(2), draw.randrange(10**12)) for _ in arcs]
    rows = [(a, b, *w) for a, b, w in zip(arcs, [*arcs[1:], listrank.NONE], weights, strict=True)]
    links = spark.createDataFrame(draw.sample(rows, len(rows)), "arc bigint, next bigint, steps bigint, leaves bigint, saved bigint").repartition(5)
    got = {r.arc: (r.steps, r.leaves, r.saved) for r in listrank.list_ranks(links, bound=50).collect()}
    sums, want = np.cumsum([(0, 0, 0), *weights], axis=0), {}
    for k, a in enumerate(arcs):
        want[a] = tuple(int(x) for x in sums[k])
    assert got == want


# ---- language-model scores


def texts_with_context(n, seed):
    """Texts in which a word depends on the one before, so that a model of history beats the counts."""
    draw = random.Random(seed)
    after = {f"w{k}": [f"w{(7 * k + j) % 60}" for j in range(3)] for k in range(60)}
    out = []
    for _ in range(n):
        word, words = f"w{draw.randrange(60)}", []
        for _ in range(draw.randrange(20, 120)):
            words.append(word.upper() if draw.random() < 0.1 else word)
            word = draw.choice(after[word])
        out.append(" ".join(words))
    return out


def token_lists(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [(i, [*re.findall("[^\x20\x09-\x0d]+", low(t)), None]) for i, t in rows]


def base_by_hand(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score); the end of a text is the token None."""
    out_of = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    lists, train = token_lists(rows), Counter()
    for i, words in lists:
        if not out_of(i):
            train.update(words)
    total, kinds = sum(train.values()), len(train)
    score = lambda ws: sum(math.log10((train[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
    return [(i, out_of(i), len(ws), sum(train[w] > 0 for w in ws), total, score(ws)) for i, ws in lists]


@pytest.mark.parametrize("head", [1 << 20, 8])
def test_scores(spark, monkeypatch, head):
    """Once with all words in the broadcast table, and once with most of them looked up by the join."""
    monkeypatch.setattr(maxent, "HEAD", head)
    rows = list(enumerate(texts_with_context(400, 1)))
    rows += [(900, None), (901, ""), (902, " \n"), (None, "w1 w2"), (903, "never seen ü\x00 words"), (904, "É é\x85x"), rows[3], rows[3]]
    rows += [(910 + k, "rare" + str(k)) for k in range(30)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, text string, hash string, score double").repartition(3)
    got = maxent.scored(docs).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    for r, w in zip(sorted(got, key=key), sorted(base_by_hand(rows), key=key), strict=True):
        assert tuple(r[:5]) == w[:5] and r.base_score == pytest.approx(w[5], rel=1e-9)
    held = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)  # of unseen texts
    same = [r.score for r in got if r.doc_id == 3]
    assert len(same) == 3 and max(same) - min(same) < 1e-9


def _model(texts):
    pieces = [maxent.tokens(p) for p in slices(pa.array(texts))]
    hashes = np.concatenate([t.hash for t in pieces])
    spelled = np.concatenate([t.spelled for t in pieces])
    kinds, first, n = np.unique(hashes, return_index=True, return_counts=True)
    top = np.argsort(-n, kind="stable")[:20]
    classes = spelled[first].astype(int)
    classes[top] = np.arange(len(top))
    head = {"hash": kinds.view(np.int64), "train": n, "total": n, "spelled": spelled[first].astype(np.int32)}
    size = maxent.SIDE**2
    counts = maxent.Counts(None, int(n.sum()), len(n), head, False, kinds[top], np.bincount(classes, n, size).astype(int), np.bincount(classes, minlength=size))
    learner = maxent.Learner(maxent.first_model(counts))
    for t in pieces * 5:
        learner.step(t)
    return learner.model, counts, dict(zip(kinds.tolist(), n.tolist(), strict=True))


def test_probabilities_by_hand(spark):
    """Feature by feature in plain Python: the same log probability, and over all words and one unseen of each class they add up to one."""
    texts = texts_with_context(40, 6)
    model, counts, seen = _model(texts)
    text = "w1 w2 never w3"
    (piece,) = slices(pa.array([text]))
    t = maxent.tokens(piece)
    scorer = maxent.scorer(model, counts)
    *_, total, _ = maxent._of_piece(scorer, piece)
    mask, odd = (1 << 64) - 1, maxent._ODD
    first_bits, second_bits = maxent.BITS

    def distribution(history):
        one, two, three = history
        features = [one * odd[0] & mask, (one * odd[1] + two * odd[2]) & mask, two * odd[3] & mask, three * odd[4] & mask]
        z = model.bias[0].astype(float) + sum(model.weight[0][f >> (64 - first_bits)].astype(float) for f in features)
        outer = np.exp(z) / np.exp(z).sum()
        out = np.zeros((maxent.SIDE, maxent.SIDE))
        for k in range(maxent.SIDE):
            salt = (k + 1) * odd[5] & mask
            z = model.bias[1][k].astype(float) + sum(model.weight[1][((f ^ salt) * odd[6] & mask) >> (64 - second_bits)].astype(float) for f in features)
            out[k] = outer[k] * np.exp(z) / np.exp(z).sum()
        return out.ravel()

    single = {int(h): k for k, h in enumerate(model.single)}
    below = counts.class_tokens + 0.5 * (counts.class_kinds + 1)
    want, past = 0.0, [maxent.BEFORE] * 3
    for h, spelled in zip(t.hash.tolist(), t.spelled.tolist(), strict=True):
        chance = distribution(past)
        assert chance.sum() == pytest.approx(1)
        want += math.log10(chance[single[h]] if h in single else chance[spelled] * (seen.get(h, 0) + 0.5) / below[spelled])
        past = [h, *past[:2]]
    assert total[0] == pytest.approx(want, abs=1e-3)
    # inside the classes by spelling, the words seen and one unseen word take all of the class
    for k in range(maxent.SINGLE, maxent.SIDE**2):
        own = [n for h, n, s in zip(counts.head["hash"].view(np.uint64).tolist(), counts.head["train"].tolist(), counts.head["spelled"].tolist(), strict=True) if s == k and h not in single]
        assert (sum(own) + 0.5 * len(own) + 0.5) / below[k] == pytest.approx(1)


def test_lookup():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        kept = np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64))
        wanted = np.concatenate([kept, draw.integers(0, 1 << 64, 500, dtype=np.uint64), np.array([0, (1 << 64) - 1], dtype=np.uint64)])
        at = {int(h): k for k, h in enumerate(kept)}
        assert maxent.Lookup(kept).of(wanted).tolist() == [at.get(int(h), -1) for h in wanted]


# ---- Merkle manifest

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, tree string, place string, root string"


def audit_by_hand(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*[field(v) for v in (*r[:4], text)])
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, a in enumerate(at):
                run = nodes[a // 16 * 16 : a // 16 * 16 + 16]
                steps[k].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
                at[k] = a // 16
            nodes = [sha(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        return nodes[0], steps

    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: tree([leaf(r, r[4]) for r in by_source[s]]) for s in names}
    root, upper = tree([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for own, r in zip(trees[s][1], by_source[s], strict=True):
            steps = own + upper[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, low(r[4]) if hit else r[4])
            for left, right in steps:
                node = sha(left, node, right)
            out.append((r[0], leaf(r, r[4]), trees[s][0], root, sha("".join(a + b for a, b in steps)), node, node == root))
    return sorted(map(str, out))


def documents(sizes, seed=1):
    draw = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = draw.choice([None, "", "Ünïcode Tëxt", "PLAIN", "lower only", "x" * 40_000])
            rows.append((draw.randrange(10**6), source, draw.choice(["en", None]), draw.choice([None, 7]), text))
    return rows


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 16}, {"a": 17}, {"a": 257, None: 1}, {f"s{k}": k % 4 + 1 for k in range(40)}, {None: 33, "": 18, "é": 2, "z": 5, "hot": 600},
])
def test_manifest(spark, sizes):
    rows = documents(sizes)
    rows += [(None, "a", None, None, None), rows[0], rows[0], (rows[0][0], *rows[0][1:4], "another text of one id")]
    docs = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], DOCS).repartition(4)
    assert sorted(str(tuple(r)) for r in merkle.audit(docs).collect()) == audit_by_hand(rows)


def test_fields_keep_null_and_empty_apart(spark):
    rows = spark.createDataFrame([(1, None, None, None, None), (1, "", None, None, None), (1, None, "", None, None), (1, "-", None, None, None)], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert rows.select(merkle.leaf()).distinct().count() == 4
    assert rows.select(merkle.field(F.lit("é")), merkle.field(F.lit(-12))).first()[:] == ("2:é", "3:-12")
