"""The opN queries without SQL, whole: each against plain Python over the same table; and the stages on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontamination, language_id, quality, sentencepiece_codec
from corpusloom.llm.chat_format import END, START
from corpusloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark):
    from conftest import SMALL

    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet").toPandas()


def _held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_scores(spark, small, tables):
    docs, labels = tables("documents"), tables("labels")
    x = np.array([quality.statistics(t) for t in docs.text])
    label = dict(zip(labels.doc_id, labels.quality))
    known = np.array([label.get(i, -1) if not _held(i) else -1 for i in docs.doc_id])
    parts = {k: x[known == k] for k in (0, 1)}
    total = sum(map(len, parts.values()))
    within = {k: np.cov(p.T, bias=True) for k, p in parts.items()}
    common = sum(len(parts[k]) * within[k] for k in parts) / total
    scale = np.sqrt(np.maximum(np.diag(common), 1e-9))
    log = {}
    for k, p in parts.items():
        mixed = (0.7 * within[k] + 0.3 * common) / np.outer(scale, scale)
        cov = 0.95 * mixed + 0.05 * np.trace(mixed) / len(mixed) * np.eye(len(mixed))
        diff = (x - p.mean(axis=0)) / scale
        log[k] = np.log(len(p) / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", diff, np.linalg.inv(cov), diff)
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
    got = QUERIES["op1_quality_classifier"](spark, small).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert np.allclose(got.score, want, atol=1e-6) and (got.predicted == (got.score >= 0.7)).all()
    assert got.held_out.tolist() == [_held(i) for i in docs.doc_id]


def test_language_predictions(spark, small, tables):
    docs = tables("documents")
    content = language_id.dictionaries(language_id.training_sample(spark.read.parquet(f"{small}/documents.parquet")))
    for lang, data in content.items():
        left = data.removesuffix(language_id.MARK)
        own = sorted((language_id._normal(t) for i, t, g in zip(docs.doc_id, docs.text, docs.lang) if g == lang and not _held(i)), key=len, reverse=True)
        for t in own:  # whole texts of the language, and nothing else
            left = left.replace(t, b"", 1)
        assert not left.strip() and len(data) <= language_id.DICTIONARY_BYTES + len(language_id.MARK)
    got = QUERIES["op5_language_id"](spark, small).toPandas().set_index("doc_id")
    for i, text in list(zip(docs.doc_id, docs.text))[::7]:
        data = language_id._normal(text)
        sizes = []
        for lang in sorted(content):
            tool = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(tool.compress(language_id.MARK + data[a : a + language_id.PIECE])) for a in range(0, len(data), language_id.PIECE)))
        best, second = sorted(sizes)[:2]
        if second - best > 0.02 * second:  # digested dictionaries may differ by a few bytes
            assert got.loc[i].lang_pred == sorted(content)[int(np.argmin(sizes))]
            assert got.loc[i].score == pytest.approx((second - best) / second, abs=0.02)


def test_simhash_query(spark, small, tables):
    docs = tables("documents")

    def print_of(text):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = [w for w in low.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        ones = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for b in range(64):
                ones[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))

    prints = [print_of(t) for t in docs.text]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    smallest = {}
    for i, d in enumerate(docs.doc_id):
        smallest[find(i)] = min(smallest.get(find(i), d), d)
    want = sorted((int(d), f"{p:016x}", int(smallest[find(i)])) for i, (d, p) in enumerate(zip(docs.doc_id, prints)))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op8_simhash_near_dedup"](spark, small).collect())
    assert got == want and len({c for _, _, c in want}) < len(want)


def test_chat_query(spark, small, tables):
    rows = tables("conversations").sort_values(["conv_id", "turn"])
    said = f"{END}{START}assistant ok"
    turns = {-1: [("user", said), ("assistant", said)]}
    for c, r, t in zip(rows.conv_id, rows.role, rows.text):
        turns.setdefault(c, []).append((r, t or ""))
    got = {r.conv_id: r for r in QUERIES["op10_chat_formatting"](spark, small).collect()}
    assert got.keys() == turns.keys()
    for c, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss), sha(loss))
        assert got[c].formatted_chars > sum(len(r) + len(t) for r, t in ts)


def test_slots_of_templates(spark):
    """Copies of one question with other values: found if recurring values keep to one value in 0.8 of their places, or if hardly any changes."""
    random.seed(6)
    form = "the farmer {} sold {} apples and {} pears to {} while the tall {} kept {} plums for {} and the miller {} took {} figs from {} at the fair"
    slots, own = "AnmBAnBCmA", {"A": "Anna", "B": "Boris", "C": "Carl", "n": "25", "m": "13"}
    names, numbers = "Anna Boris Carl Dora Emil Fred Gina Hugo".split(), ["25", "13", "31", "47", "58"]
    item = form.format(*(own[s] for s in slots))
    windows = lambda t: [tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)]
    rows, want = [], set()
    for k in range(120):
        new = dict(zip("ABC", random.sample(names, 3))) | dict(zip("nm", random.sample(numbers, 2)))
        values = [new[s] for s in slots]
        if k % 4 == 0:
            values = [own[s] for s in slots]
        for _ in range(k % 3):  # spoil one place or two
            i = random.randrange(len(slots))
            values[i] = random.choice(names if slots[i].isupper() else numbers)
        text = form.format(*values)
        pairs = {(own[s], v) for s, v in zip(slots, values)}
        put = {s: [v for t, v in zip(slots, values) if t == s] for s in set(slots) if slots.count(s) > 1}
        kept = sum(max(map(vs.count, vs)) for vs in put.values()) >= 0.8 * sum(map(len, put.values()))
        same = len(set(windows(item)) & set(windows(text))) >= 0.8 * len(set(windows(item)))
        rows.append((k, f"So it says: {text} and no more."))
        if kept or same:
            want.add((k, "verbatim" if all(a == b for a, b in pairs) else "reparameterised"))
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {(r.doc_id, r.kind) for r in decontamination.leaks(docs, items).collect()} == want and 30 < len(want) < 118


@pytest.mark.parametrize("extra_spaces,user", [(True, False), (False, False), (True, True)])
def test_unigram_model(tmp_path, extra_spaces, user):
    """A unigram model written by hand (none is trained): scores, white-space rules, byte fallback and user pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    add = lambda piece, score, kind: proto.pieces.add(piece=piece, score=score, type=kind)
    add("<unk>", 0, 2), add("<s>", 0, 3), add("</s>", 0, 3)
    for b in range(256):
        add(f"<0x{b:02X}>", 0, 6)
    if user:
        add("[SEP]", 0, 4)
    words = "▁the ▁cat ▁ca ca t at s ing ▁sing ▁ the c a h e i n g o r d ▁world wor ld l w".split()
    for k, w in enumerate(words):
        add(w, -1.37 * len(words) / (3 + len(w)) - 0.0173 * k, 1)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = 1, True
    proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.escape_whitespaces = True
    proto.normalizer_spec.remove_extra_whitespaces = extra_spaces
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    own, other = sentencepiece_codec.Codec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for text in ["", "the cats sing", "the  cat", " the cat ", "theca world", "caté\n☃ the", "singing cats ▁ world", *(["the[SEP]cat [SEP] sing"] if user else [])]:
        ids = own.encode([text])[0].tolist()
        assert ids == other.encode(text), text
        assert own.decode(ids) == other.decode(ids), text


ODD = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, lang_score double, row_key string, removed int, ids string"


def _odd(spark, small):
    base = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60")
    rows = base.select("doc_id", "text", "lang", "source", "n_chars").collect()
    more = [(None, None, None, None, None), (None, "", None, "s", 0), (3, None, "en", None, None), (None, rows[0].text, None, None, None), (1, "!!!", None, None, None), tuple(rows[1]), tuple(rows[1])]
    return spark.createDataFrame([(*r, "x", 0.5, "k", 1, "i") for r in [*map(tuple, rows), *more]], ODD)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, small, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], _odd(spark, small)
    rows = stage(spark, docs, small).collect()
    assert 0 < len(rows) <= docs.count()
    if name != "sentencepiece":
        assert rows[0].__fields__ == docs.columns and all(r.row_key == "k" and r.ids == "i" for r in rows)
    else:
        assert len(rows) == docs.count() and all(r.n_tokens == len(r.ids) for r in rows)
    if name == "language_id":  # letterless texts are rejected
        assert all(r.text and any(c.isalpha() for c in r.text) for r in rows)
    if name == "line_dedup":
        assert {(r.doc_id, r.text) for r in rows} >= {(None, None), (None, ""), (3, None), (1, "!!!")}
    assert stage(spark, docs.limit(0), small).count() == 0


def test_pipeline_of_nothing(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{small}/benchmark.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{small}/documents.parquet").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("n_tokens").isNull()).count() == 0
