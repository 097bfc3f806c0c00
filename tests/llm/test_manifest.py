"""Op 13: leaves, roots and proofs equal those of a plain recursion; the layout is a permutation."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.manifest import address, audit, build, document_manifest, fold, leaf_of, tree_size

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_text(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout=16):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        levels.append(nodes)
    return levels


def way(levels, i, fanout=16):
    out = []
    for level in levels[:-1]:
        low = i - i % fanout
        out.append((level[low:i], level[i + 1 : low + fanout]))
        i //= fanout
    return out


def plain(rows, fanout=16):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    members = {g: sorted(((r[0] is not None, r[0] or 0, leaf_text(*r)), r) for r in groups[g]) for g in names}
    trees = {g: tree([m[0][2] for m in members[g]], fanout) for g in names}
    over = tree([trees[g][-1][0] for g in names], fanout)
    out = []
    for j, g in enumerate(names):
        for i, (key, r) in enumerate(members[g]):
            path = way(trees[g], i, fanout) + way(over, j, fanout)
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[4] if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            at = leaf_text(*r[:4], text) if touched else key[2]
            for left, right in path:
                at = sha("".join(left) + at + "".join(right))
            root = over[-1][0]
            out.append((r[0], key[2], trees[g][-1][0], root, sha("".join("".join(a + b) for a, b in path)), at, at == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels, fanout", [(1, 16), (2, 16), (3, 4), (4, 16), (5, 3), (6, 2)])
def test_layout_is_a_permutation_with_halves_first(levels, fanout):
    places = [address(levels, d, np.arange(fanout**d), fanout) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(tree_size(levels, fanout)))
    assert places[0][0] == 0
    top = levels // 2
    if top:
        assert sorted(np.concatenate(places[:top]).tolist()) == list(range(tree_size(top, fanout)))


def cases():
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} ÄB") for i in range(130)]
    rows += [(i, None, None, None, None) for i in (500, 501)] + [(600, "", "", 0, ""), (None, "s1", "de", 1, "X"), (None, None, None, None, None)]
    rows += [(7, "s1", "en", 7, "Text 7 ÄB")] * 3 + [(7, "s1", "en", 7, "other")]
    rows += [(1000 + i, f"host{i}", "en", 1, "Long " * 2000) for i in range(40)] + [(2000, "é", "fr", 1, "ab"), (2001, "z", "fr", 1, "ab"), (-5, "z", "fr", -1, "A")]
    return rows


@pytest.mark.parametrize("height", [1, 3])
def test_equals_plain_recursion(spark, height):
    docs = spark.createDataFrame(cases(), SCHEMA).withColumn("leaf", F.lit("clash")).withColumn("index", F.lit(1)).repartition(3)
    got = document_manifest(docs, height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == plain(cases())
    assert not all(r[-1] for r in rows) and any(r[-1] for r in rows)


def test_one_source_one_row_and_none(spark):
    one = [(3, "only", "en", 1, "t")]
    assert [tuple(r) for r in document_manifest(spark.createDataFrame(one, SCHEMA)).collect()] == plain(one)
    assert document_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_proofs_fold_to_the_root_and_another_fanout(spark):
    rows = spark.createDataFrame([(i, "g" if i % 5 else "h", f"v{i}") for i in range(70)], "id long, part string, v string")
    made = build(rows.withColumn("leaf", leaf_of(F.col("id"), F.col("v"))), "part", "id", "leaf", height=2, fanout=3)
    out = audit(made, "leaf", with_path=True).collect()
    assert len(out) == 70 and all(r.verified for r in out) and len({r.root for r in out}) == 1
    assert all(fold(r["row"]["leaf"], r.path) == r.root and sha("".join(r.path)) == r.proof_sha256 for r in out)
    with pytest.raises(ValueError):
        build(rows, "part", "id", "v", fanout=1)
