import hashlib
import random
import zlib

import pytest

from tidemark.llm.merkle import collapse, document_manifest, fold, height, manifest, siblings


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    layers = [list(leaves)]
    while len(layers[-1]) > 1:
        layers.append([h(*layers[-1][j : j + 3]) for j in range(0, len(layers[-1]), 3)])
    return layers


def path(layers, i):
    out = []
    for layer in layers[:-1]:
        run = i // 3 * 3
        out.append((layer[run:i], layer[i + 1 : run + 3]))
        i //= 3
    return out


def brute(rows):
    """Sorted results of (doc_id, source, lang, n_chars, text), straight from the definition."""
    sources = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        sources.setdefault(r[1], []).append(r)
    trees = {s: tree([leaf_of(r) for r in rs]) for s, rs in sources.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top, out = tree([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, r in enumerate(sources[s]):
            steps = path(trees[s], i) + path(top, k)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf_of((*r[:4], r[4].replace("\n", ""))) if even and r[4] is not None else leaf_of(r)
            for left, right in steps:
                folded = h(*left, folded, *right)
            proof = h(*(x for left, right in steps for x in left + right))
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def many_rows(n):
    rnd = random.Random(n)
    sources = [None, "a", "é", "日本", "b", ""]
    return [(rnd.randrange(n), rnd.choice(sources[:2]) if k % 3 else rnd.choice(sources), None, k if k % 7 else None, rnd.choice([None, "", "a\nb", "x", "\n", "ünï\n\n"])) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 40])
def test_layers_and_proofs(n):
    leaves = [h(str(i)) for i in range(n)]
    layers = collapse(leaves, height(n))
    assert layers == tree(leaves)
    for i in range(n):
        assert fold(leaves[i], siblings(layers, i)) == layers[-1][0]
        assert [("".join(a), "".join(b)) for a, b in path(layers, i)] == list(zip(siblings(layers, i)[::2], siblings(layers, i)[1::2]))


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_any_block_size_equals_the_definition(spark, levels):
    """Trees of one to many rounds of blocks, null and non-ASCII sources, repeated ids."""
    rows = many_rows(400)
    df = spark.createDataFrame([(*r, leaf_of(r)) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(5)
    got = manifest(df, "source", ["doc_id"], "leaf", "leaf", ["doc_id"], levels=levels)
    want = sorted(((*r[:5], r[3], True) for r in brute([(*r[:4], r[4]) for r in rows])), key=str)
    assert found(got) == want


def test_tampered_texts_are_found(spark):
    rows = many_rows(150)
    got = found(document_manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")))
    assert got == brute(rows) and 0 < sum(r[-1] for r in got) < len(got)


def test_sources_of_many_levels(spark):
    rows = [(i, f"s{i % 100}", "en", 1, f"t{i}\n") for i in range(230)]
    assert found(document_manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))) == brute(rows)


def test_odd_rows(spark, edge, nothing):
    rows = [tuple(r) for r in edge.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert found(document_manifest(edge)) == brute(rows)
    assert document_manifest(nothing).count() == 0


def test_one_key_of_a_third_of_the_rows(spark):
    """Equal rows without an id are spread over places, each with a proof of its own."""
    rows = [(None, None, "en", 1, "same")] * 700 + [(i, "a", "en", 1, f"t{i}") for i in range(30)]
    got = found(document_manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")))
    assert got == brute(rows) and all(r[-1] for r in got)
