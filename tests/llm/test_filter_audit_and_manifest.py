"""Filter audit and Merkle manifest against plain Python, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest

from corpusloom.llm import filter_audit, manifest
from corpusloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, part string, place int, leaf string, mask int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, n, "k", "p", 1, "l", 3) for i, t, g, s, n in rows], DOCS)


def _audit(docs, labels):
    first, quality, toxic = {}, set(), set()
    for i, t, _, _, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        quality |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    rows = []
    for i, t, _, s, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        rows.append((s or "", bad, i in quality, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                shapley[f] += len(gone)
                kept = [r for r in left if not r[1][f]]
                fails = sum(r[1][f] for r in own)
                out[part, "".join(order), step] = [len(kept), len(gone), fails - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                left = kept
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_intervals_cover_every_order_once():
    for mask in range(1, 32):
        for rank, order in enumerate(permutations(range(5))):
            want = next(step for step, f in enumerate(order, 1) if mask >> f & 1)
            got = [s for s in range(1, 6) if sum(d for m, step, r, d in filter_audit.interval_ends(5) if (m, step) == (mask, s) and r <= rank) == 1]
            assert got == [want]
        if mask > 6:  # the rule is the same for all
            break


def test_audit_by_brute_force(spark):
    rnd = random.Random(5)
    texts = [None, "", "one two", "ONE TWO THREE", "a#b", *(" ".join(rnd.choice("alpha beta gamma Delta EPS \t\x0b\n é x$".split(" ")) + str(rnd.randrange(k)) for _ in range(60)) for k in (2, 30, 1000))]
    docs = [(rnd.choice([None, *range(40)]), rnd.choice(texts), "en", rnd.choice([None, "", "s1", "s2"]), 1) for _ in range(300)]
    labels = [(rnd.choice([None, *range(40)]), rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1])) for _ in range(60)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    got = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in filter_audit.audit(filter_audit.failure_cells(_docs(spark, docs), frame)).collect()}
    assert got == _audit(docs, labels)
    assert filter_audit.audit(filter_audit.failure_cells(_docs(spark, []), frame)).count() == 0


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(i, t, g, s, n):
    return _h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, s, g, n, t)))


def _tree(values):
    """The top, and for each value the siblings (left, right) level by level."""
    levels = [values]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][a : a + 16]) for a in range(0, len(levels[-1]), 16)])
    out = []
    for at in range(len(values)):
        own = []
        for level in levels[:-1]:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            own.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            at //= 16
        out.append(own)
    return levels[-1][0], out


def _manifest(docs):
    by = {}
    for d in docs:
        by.setdefault(d[3], []).append(d)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda d: (d[0] is not None, d[0] or 0, _leaf(*d)))
        trees[s] = own, *_tree([_leaf(*d) for d in own])
    root, upper = _tree([trees[s][1] for s in names])
    out = []
    for s, above in zip(names, upper):
        own, sub, below = trees[s]
        for d, path in zip(own, below):
            i, t = d[0], d[1]
            hit = i is not None and t is not None and zlib.crc32(str(i).encode()) % 5 == 0
            h = _leaf(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in t), *d[2:]) if hit else _leaf(*d)
            for left, right in path + above:
                h = _h(left, h, right)
            out.append((i, _leaf(*d), sub, root, _h(*(a + b for a, b in path + above)), h, h == root))
    return sorted(out, key=str)


def _rows(frame):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in frame.collect()), key=str)


@pytest.mark.parametrize("case", ["mixed", "lone", "one source", "plain", "far ids"])
def test_manifest_by_brute_force(spark, case):
    rnd = random.Random(9)
    text = lambda: rnd.choice([None, "", "Some Text é", "lower", "UP" * rnd.randrange(3)])
    if case == "mixed":  # nulls, ids that repeat with equal and other rows, sources of very different sizes
        docs = [(rnd.choice([None, 7, rnd.randrange(-50, 3000)]), text(), rnd.choice([None, "en"]), rnd.choice(["big", "big", "big", None, "", "é", f"s{rnd.randrange(40)}"]), rnd.choice([None, 3])) for _ in range(900)]
    elif case == "lone":
        docs = [(5, "A", None, None, None)]
    elif case == "one source":
        docs = [(i, f"T{i}", "x", "s", i) for i in range(17)]
    elif case == "plain":
        docs = [(i * 3, f"T{i}", "x", f"s{i % 3}", i) for i in range(1500)]
    else:
        docs = [(rnd.randrange(-(2**63), 2**63), "x", None, "s", 1) for _ in range(300)]
    assert _rows(manifest.manifest(_docs(spark, docs))) == _manifest(docs)


def test_manifest_of_nothing(spark):
    assert manifest.manifest(_docs(spark, [])).count() == 0


def test_manifest_query(spark, small):
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert _rows(QUERIES["op12_merkle_manifest"](spark, small)) == _manifest(docs)
