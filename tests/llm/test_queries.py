"""Each query of the package over a small table: against its SQL, else against a plain version."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_line_dedup import group_by_all_pairs
from tests.llm.test_ngram_join import plain
from tests.llm.test_quotes import order
from tests.test_entry import same
from tribune.llm import line_dedup, mixing, pieces, quality, queries, url_filter


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    same(spark, name, queries.QUERIES[name], queries.ORACLES[name], sf_dir)


def test_names():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 14)] == [1] * 13


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return queries.table(spark, sf_dir, "documents").toPandas()


def test_op1(spark, sf_dir, docs):
    codec = pieces.Codec(pieces.read_model(queries.PIECES))
    got = {r.doc_id: r for r in queries.op1_sentencepiece(spark, sf_dir).collect()}
    assert len(got) == len(docs) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values())
    for i, text in list(zip(docs.doc_id, docs.text))[:10]:
        assert list(got[i].ids) == codec.segment("▁" + text.replace(" ", "▁"))


def test_op2(spark, sf_dir, docs):
    expect = plain(list(zip(docs.doc_id, docs.text)))
    got = {r.doc_id: (r.n_links, r.class_id) for r in queries.op2_ngram_jaccard(spark, sf_dir).collect()}
    assert got == expect


def test_op3(spark, sf_dir):
    pages = {r.page_id: r.url for r in queries.table(spark, sf_dir, "pages").collect()}
    got = queries.op3_url_filter(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        rest = pages[r.page_id].split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        assert (r.host, r.path) == (host, path)
        fits = [(len(x), x, v) for x, v in url_filter.RULES if f".{host}".endswith("." + x.split("/")[0]) and path.startswith("/" + x.split("/", 1)[1])]
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "allow"))  # the test pages have no links between hosts


def test_op5(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "conversations").collect()
    got = queries.op5_chat_quotes(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for conv in {r.conv_id for r in rows}:
        turns, _ = order([(r.turn, r.text) for r in rows if r.conv_id == conv])
        assert [r.turn for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)] == turns


def test_op7(spark, sf_dir, docs):
    got = {(r.doc_id, r.line_no): r for r in queries.op7_fuzzy_lines(spark, sf_dir).collect()}
    every = {(i, n): line_dedup.normalised(x) for i, t in zip(docs.doc_id, docs.text) for n, x in enumerate(t.split("\n")) if x.strip()}
    assert set(got) == set(every)
    top = group_by_all_pairs(sorted(set(every.values())))
    sizes, first = Counter(top[t] for t in every.values()), {}
    for k in sorted(every):
        first.setdefault(top[every[k]], k)
    whole = [r.group_size == sizes[top[every[k]]] and (r.keep_doc_id, r.keep_line_no) == first[top[every[k]]] for k, r in got.items()]
    print("lines whose group is that of all pairs:", sum(whole), "of", len(whole))
    assert np.mean(whole) >= 0.99
    for k, r in got.items():
        assert r.group_size <= sizes[top[every[k]]] and r.kept == (k == (r.keep_doc_id, r.keep_line_no))
        assert top[every[k]] == top[every[r.keep_doc_id, r.keep_line_no]]


def test_op8(spark, sf_dir, docs):
    got = queries.op8_quality_classifier(spark, sf_dir).collect()
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf_dir, "labels").collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.9 if bad else True


def test_op11(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_BPE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_chunked_bpe(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_pipeline(spark, sf_dir, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    frame = queries.table(spark, sf_dir, "documents")
    from pyspark.sql import functions as F

    weights = quality.train(frame, queries.table(spark, sf_dir, "labels"), learnable=~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0))
    assert any(held(i) for i in docs.doc_id)
    # quality: plain sums over features
    known = quality._Words()
    kept = []
    for r in docs.itertuples():
        feats, _ = quality.features([r.text], known)
        logit = quality.SCALE * sum(float(np.float32(weights[f])) for row in feats for f in row) / max(1, feats.shape[1]) + weights[-1]
        if 1 / (1 + math.exp(-logit)) >= quality.THRESHOLD:
            kept.append(r)
    # exact copies
    best = {}
    for r in kept:
        key = "".join(c for c in r.text if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (0, math.inf, None)), (-len(r.text), r.doc_id, r), key=lambda x: x[:2])
    kept = [x[2] for x in best.values()]
    groups = plain([(r.doc_id, r.text) for r in kept])
    kept = [r for r in kept if groups[r.doc_id][1] == r.doc_id]
    # mixture
    size = Counter()
    for r in kept:
        size[r.source] += r.n_chars
    total = sum(size.values())
    left = 1 - sum(mixing.TARGETS.values())
    others = {s: n for s, n in size.items() if s not in mixing.TARGETS}
    shares = {s: mixing.TARGETS[s] for s in size if s in mixing.TARGETS} | {s: left * n / sum(others.values()) for s, n in others.items()}
    expect = Counter()

    for r in kept:
        rate = shares[r.source] / sum(shares.values()) * total / size[r.source]
        u = (int(hashlib.md5(f"{r.doc_id}:{mixing.SEED}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rate)
        while p < u:
            k += 1
            p += math.exp(-rate) * rate**k / math.factorial(k)
        expect[r.doc_id] = k
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == +expect
    codec = pieces.Codec(pieces.read_model(queries.PIECES))
    texts = dict(zip(docs.doc_id, docs.text))
    for r in got[:20]:
        assert codec.decode(np.array(r.ids), np.array([len(r.ids)])) == [texts[r.doc_id]]
    # every stage but the last returns the columns of documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame.limit(30), sf_dir).columns == frame.columns
