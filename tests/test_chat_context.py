"""The composed context of answers against a plain computation, over a table of questions."""

import random

from corpusloom.operators import chat


def _plain(questions, hits, raw, exact, sections, listed, o):
    sec, out = {s[0]: s for s in sections}, []
    for q, legal in questions:
        own = sorted((h for h in hits if h[0] == q), key=lambda h: h[2])
        typed = sorted((h for h in raw if h[0] == q), key=lambda h: h[2])
        if own and max(h[3] for h in own) >= o.threshold:
            found = [(h[1], h[3], "gate") for h in own if h[3] >= o.threshold or (h[4] and h[3] >= o.support)]
        elif any(h[3] >= o.threshold for h in typed):
            found = [(h[1], h[3], "raw") for h in typed if h[3] >= o.threshold]
        elif legal:
            best = {}
            for h in own + typed:
                best[h[1]] = max(h[3], best.get(h[1], 0))
            found = [(k, r, "rescued") for k, r in sorted(best.items(), key=lambda x: (-x[1], x[0])) if r >= o.floor][: o.k]
        else:
            found = []
        if listed is not None:
            opened, seen = [], set()
            for nth, (k, r, how) in enumerate(found):
                opened += [(nth, s, r, "listed") for t, s in listed if t == k] if any(t == k for t, _ in listed) else [(nth, k, r, how)]
            for nth, k, r, how in sorted(opened, key=lambda x: (x[0], x[3])):
                if k not in seen:
                    seen.add(k)
            best = {}
            for x in sorted(opened, key=lambda x: (x[0], x[3])):
                best.setdefault(x[1], x)
            found = [(k, r, how) for nth, k, r, how in sorted(best.values(), key=lambda x: (x[0], x[1]))]
        named = [k for _, k, _ in sorted((e for e in exact if e[0] == q), key=lambda e: (e[2], e[1]))]
        rows = [(k, 1.0, "exact") for k in named] + [f for f in found if f[0] not in named]
        rows = rows[: o.k]
        if o.neighbours and rows and rows[0][0] in sec and rows[0][1] >= o.threshold:
            _, law, seq, status, _ = sec[rows[0][0]]
            near = [s for d in (-1, 1) for s in sections if s[1] == law and s[2] == seq + d]
            rows[1:1] = [(s[0], None, "neighbour") for s in near if (s[3] != "repealed" or status == "repealed") and s[0] not in {r[0] for r in rows}]
        n = 0
        for place, (k, r, how) in enumerate(rows, 1):
            n += k in sec
            out.append((q, place, k, how, r, sec[k][4][: o.chars if n <= o.whole else o.passage] if k in sec else None))
    return sorted(out)


def test_context_is_the_plain_one(spark):
    rnd = random.Random(21)
    sections = [(k, k // 10, k % 10, rnd.choice([None, "in force", "repealed"]), f"text of {k} " * 9) for k in range(60)]
    questions = [(q, rnd.random() < 0.5) for q in range(70)]

    def hits(low):
        rows = []
        for q, _ in questions:
            top = rnd.choice([0.45, 0.6, 0.9]) - low
            keys = rnd.sample(range(80), rnd.randrange(9))
            scores = sorted((round(rnd.uniform(0.3, top), 3) for _ in keys), reverse=True) if top > 0.3 else [0.3] * len(keys)
            rows += [(q, k, n, s, k < 60) for n, (k, s) in enumerate(zip(keys, scores), 1)]
        return rows

    search, typed = hits(0.0), hits(0.1)
    exact = [(q, k, n) for q, _ in questions if rnd.random() < 0.3 for n, k in enumerate(rnd.sample(range(60), rnd.choice([1, 2])))]
    listed = [(t, s) for t in (61, 62, 5) for s in rnd.sample(range(60), 3)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    kind = "qid long, key long, rank int, relevance double, is_section boolean"
    tables = frame(questions, "qid long, legal boolean"), frame(search, kind), frame(typed, kind), frame(exact, "qid long, key long, at int"), frame(sections, "key long, law long, seq long, status string, text string")
    for contents, o in ((None, chat.ContextOptions()), (listed, chat.ContextOptions(k=4, whole=2, chars=20, passage=5)), (listed, chat.ContextOptions(neighbours=False, threshold=0.5, support=0.4))):
        got = chat.context(*tables, None if contents is None else frame(contents, "key long, section_key long"), o)
        rows = sorted((r.qid, r.place, r.key, r.how, r.relevance, r.text) for r in got.collect())
        assert [r[:4] + r[5:] for r in rows] == [r[:4] + r[5:] for r in _plain(questions, search, typed, exact, sections, contents, o)]
        assert {r[3] for r in rows} >= {"gate", "raw", "exact"} | ({"rescued", "neighbour"} if o.threshold > o.floor else {"listed"})
