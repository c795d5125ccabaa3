"""The manifest against a plain tree, and its paths against the digests that they lead to."""

import hashlib
import zlib

from lakewright.llm import merkle as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long, seq string, at int, count int, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(d, t, lang, s, n):
    return h(*map(enc, (d, s, lang, n, t)))


def floors(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def walk(levels, k):
    for nodes in levels[:-1]:
        yield nodes[k - k % 3 : k - k % 3 + 3], k % 3
        k //= 3


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[s] = own, floors([leaf_of(*r) for r in own])
    upper = floors([trees[s][1][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        own, levels = trees[s]
        for k, r in enumerate(own):
            siblings, now = [], leaf_of(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                now = leaf_of(r[0], r[1].replace("\n", ""), *r[2:])
            for run, pos in [*walk(levels, k), *walk(upper, place)]:
                siblings += run[:pos] + run[pos + 1 :]
                now = h(*run[:pos], now, *run[pos + 1 :])
            out.append((r[0], leaf_of(*r), levels[-1][0], upper[-1][0], h(*siblings), now, now == upper[-1][0]))
    return out


KEY = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))


def proofs_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS).repartition(7)
    return M.manifest(df, tampered=M.without_newlines(df))


def test_tree_of_several_stages(spark):
    rows = [(i, f"a\nb {i}", "en", "hot", i) for i in range(2300)] + [(5000 + i, "one\nline", None, f"s{i:03d}ü", None) for i in range(800)]
    rows += [(9000, None, None, None, None), (9001, "", "de", None, 0), (9001, "", "de", None, 0), (9001, "z\n", "de", None, 0), (None, "\n", "de", "hot", 1), (None, "\n", "de", None, 1), (9002, "w " * 80_000 + "\n", "en", "", 5)]
    made = proofs_of(spark, rows)
    got = made.proofs().collect()
    found = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got]
    assert sorted(found, key=KEY) == sorted(plain(rows), key=KEY)
    assert {r.verified for r in got} == {True, False}
    for r in got[::50]:
        assert M.folded(bytes.fromhex(r.leaf), bytes(r.path)).hex() == made.root


def test_small_tables(spark):
    assert proofs_of(spark, []).root is None and proofs_of(spark, []).proofs().count() == 0
    for rows in ([(1, "a\n", "en", "s", 2)], [(3, "t", None, "a", 1), (4, "t\n", None, "a", 1)], [(1, "x", "en", None, 1), (2, "x", "en", "b", 1)]):
        made = proofs_of(spark, rows)
        found = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in made.proofs(keep_path=False).collect()]
        assert sorted(found, key=KEY) == sorted(plain(rows), key=KEY)


def test_levels_are_written_in_order_of_their_places(spark):
    made = proofs_of(spark, [(i, "t", "en", "s", 1) for i in range(2000)])
    assert made.rows.bases == [0, 6]
    for level, n in ((1, 667), (6, 3), (7, 1)):
        nodes = [r["at"] for r in made.rows.nodes().where(f"level = {level}").orderBy("at").collect()]
        assert nodes == list(range(n))
