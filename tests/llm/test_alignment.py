"""The alignment of two tokenizers against the libraries and plain loops over byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from learntrail.llm import alignment

ODD = [(1, "a b c d e f"), (2, None), (3, ""), (4, "  \n\t "), (5, "word"), (6, "a b c d e f"), (7, "x" * 30_000), (8, "é ñ 日本語 😀 <|endoftext|> don't <s> <0x0A>"), (None, "no id here"), (6, "a b c d e f"), (9, "a▁b"), (10, "Grüße, naïve café unbelievably")]


def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(texts):
    """Per text: n_a, n_b, n_groups, links as id pairs, digest, pairs of one group; from offsets that the libraries give."""
    a_lib, b_lib = libraries()
    signs = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    signs |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(signs.values()))}
    a_bytes = lambda k: bytes(signs[c] for c in a_lib.id_to_token(k))

    def b_bytes(k):
        piece = b_lib.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(k) else piece.replace("▁", " ").encode()

    for text in texts:
        a, b = ([], []) if not text else (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text))
        if any(b"".join(x) != (" " + text).encode() for x in ([a_bytes(k) for k in a], [b_bytes(k) for k in b])) if text else True:
            yield 0, 0, 0, [], "", 0
            continue
        spans = []
        for ids, of in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for k in ids:
                own.append((at, at := at + len(of(k)), k))
            spans.append(own)
        links, first = [], 0
        for s, e, k in spans[0]:
            while spans[1][first][1] <= s:
                first += 1
            j = first
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((k, spans[1][j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, begin, shared, i, j = [], 0, 0, 0, 0
        for cut in cuts:
            i2 = next(x for x in range(i, len(spans[0])) if spans[0][x][1] == cut) + 1
            j2 = next(x for x in range(j, len(spans[1])) if spans[1][x][1] == cut) + 1
            groups.append(",".join(str(k) for _, _, k in spans[0][i:i2]) + "|" + ",".join(str(k) for _, _, k in spans[1][j:j2]))
            shared += (i2 - i) * (j2 - j)
            i, j = i2, j2
        yield len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest(), shared


def wanted(rows):
    found = list(brute([t for _, t in rows]))
    counts = Counter(p for x in found for p in x[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((d, x[0], x[1], x[2], len(x[3]), sum(counts[p] == most[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4], x[5]) for (d, _), x in zip(rows, found, strict=True)), key=str)


def mixed(rng, n=300):
    parts = ["the ", "un", "believ", "able ", "日本", "é", " ", "\n", "1234", "<s>", "!!", "qxz", "😀", "Haus", "  ", "ing", "\t", "́"]
    return [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(n)]


def test_statistics_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 1500)
    rows = ODD + mixed(random.Random(5))
    frame = spark.createDataFrame([(*r, "x", 5, b"y") for r in rows], "doc_id long, text string, block string, kind int, keys binary").repartition(5)
    assert sorted((tuple(r) for r in alignment.alignment_statistics(frame).collect()), key=str) == wanted(rows)
    assert alignment.alignment_statistics(frame.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "twice told"), (2, None), (3, "twice told")], "doc_id int, text string")
    assert sorted((tuple(r) for r in alignment.alignment_statistics(same).collect()), key=str) == wanted([(1, "twice told"), (2, None), (3, "twice told")])


def test_pairs_over_several_salts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "MOST", 3)
    monkeypatch.setattr(alignment, "LEAST", 1)
    rows = mixed(random.Random(6), 120)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in alignment.alignment_statistics(frame).collect()), key=str) == wanted(rows)


def test_links_of_documents(spark):
    rows = [r for r in ODD + mixed(random.Random(7), 60) if r[0] is not None]
    rows = list(dict(rows).items())
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in alignment.align_documents(frame).collect()}
    for (doc, _), x in zip(rows, brute([t for _, t in rows]), strict=True):
        r = found[doc]
        assert [(r.a_ids[i], r.b_ids[j]) for i, j in zip(r.link_a, r.link_b, strict=True)] == x[3]
        assert len(set(r.a_groups)) == len(set(r.b_groups)) == x[2] and (not r.a_groups or r.a_groups[0] == 0)
        pairs = [p for a, b in alignment.shared_group_links(np.array(r.a_groups, np.int64), np.array(r.b_groups, np.int64), x[2]) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(pairs) == x[5] and all(r.a_groups[i] == r.b_groups[j] for i, j in pairs)


def test_sparse_products():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, k, m = rng.integers(1, 12, 3)
        a, b = ((rng.random(s) < 0.3) * rng.integers(1, 5, s) for s in ((n, k), (k, m)))
        csr = lambda x: alignment.Csr(np.r_[0, np.cumsum((x > 0).sum(1))], np.nonzero(x)[1], x[x > 0], x.shape[1])
        out = np.zeros((n, m), np.int64)
        for rows, columns, values in alignment.product_entries(csr(a), csr(b), terms=3):
            out[rows, columns] = values
        assert (out == a @ b).all()
        back = csr(a).transposed()
        assert (np.diff(back.starts) == (a > 0).sum(0)).all()


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in alignment.op13_alignment(spark, sf_dir).collect()), key=str) == wanted(rows)


def test_kept_chunks_give_the_ids_of_whole_texts(monkeypatch):
    """Few chunks are encoded again, and odd spaces, line breaks and special strings give what the library gives."""
    rng = random.Random(8)
    signs = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "é", "é", "😀", "<s>", "<0x41>", " ", "　", ".", "ing", "\0", "\r\n"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(3000)]
    model = libraries()[1]
    want = model.encode(texts)
    asked = []
    pieces = alignment.Pieces(model)
    monkeypatch.setattr(pieces, "model", type("Counted", (), {"encode": lambda self, x, **k: asked.extend([x] if isinstance(x, str) else x) or model.encode(x, **k)})())
    for _ in range(2):
        ids, counts = pieces.encode(texts)
        ends = np.r_[0, np.cumsum(counts)]
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
    assert pieces.parted and len(asked) == len(set(asked))  # none twice
    monkeypatch.setattr(alignment, "KEPT", 10)
    assert pieces.encode(texts)[0].tolist() == [k for own in want for k in own]
