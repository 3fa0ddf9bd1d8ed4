import math
import zlib
from collections import Counter, defaultdict

import pytest

from structweave.llm.ppm import ORDER, op9_ppm, score

from .conftest import EDGES


def brute(rows):
    """Base columns and PPM scores from dictionaries, symbol by symbol."""
    train = [t or "" for i, t in rows if zlib.crc32((str(i) if i is not None else "").encode()) % 7 != 2]
    words = Counter()
    contexts = [defaultdict(Counter) for _ in range(ORDER + 1)]

    def symbols(text):
        return [256] * ORDER + list(text.encode()) + [257]

    for text in train:
        words.update([*text.encode().lower().split(), None])
        s = symbols(text)
        for p in range(ORDER, len(s)):
            for k in range(ORDER + 1):
                contexts[k][tuple(s[p - k : p])][s[p]] += 1
    known = {}

    def cost(context, symbol):
        excluded, total = set(), 0.0
        for k in range(ORDER, -1, -1):
            found = contexts[k].get(context[ORDER - k :])
            if found is None:
                continue
            left = {x: n for x, n in found.items() if x not in excluded}
            weight, kinds = sum(left.values()), len(left)
            if symbol in left:
                return total + math.log10(left[symbol] / (weight + kinds))
            total += math.log10(kinds / (weight + kinds)) if kinds else 0.0
            excluded |= set(found)
        return total - math.log10(257 - len(excluded))

    n, v, out = sum(words.values()), len(words), []
    for i, text in rows:
        tokens = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        s, total = symbols(text or ""), 0.0
        for p in range(ORDER, len(s)):
            key = tuple(s[p - ORDER : p + 1])
            if key not in known:
                known[key] = cost(key[:-1], key[-1])
            total += known[key]
        out.append((zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2, len(tokens), sum(words[w] > 0 for w in tokens), n, base, total))
    return out


def same(found, wanted):
    key = lambda r: (r[0], r[1], round(r[4], 4), round(r[5], 4))
    for a, b in zip(sorted(found, key=key), sorted(wanted, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-6)


def columns(r):
    return r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same([columns(r) for r in op9_ppm(spark, sf).collect()], brute(rows))


def test_edges_and_blocks(edge_docs, no_docs, monkeypatch):
    wanted = brute([(i, t) for i, t, _ in EDGES])
    same([columns(r) for r in score(edge_docs).collect()], wanted)
    monkeypatch.setattr("structweave.llm.ppm.BLOCK_CHARS", 50_000)
    same([columns(r) for r in score(edge_docs.repartition(3)).collect()], wanted)
    assert score(no_docs).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = score(spark.createDataFrame([(held, "ab")], "doc_id bigint, text string")).first()
    assert columns(r) == (True, 2, 0, 0, 0.0, pytest.approx(3 * math.log10(1 / 257)))
