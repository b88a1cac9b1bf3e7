import numpy as np

from tessera.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int, key long, node string, tile int"


def brute(rows, least=0.95):
    ok = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    n, comp = {}, {id(r): r for r in ok}
    find = lambda r: r if comp[id(r)] is r else find(comp[id(r)])
    links = [0] * len(ok)
    for i, a in enumerate(ok):
        for j, b in enumerate(ok[:i]):
            if len(a[1]) != len(b[1]):
                continue
            x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                comp[id(find(a))] = find(b)
    least_id = {}
    for r in ok:
        if r[0] is not None:
            k = id(find(r))
            least_id[k] = min(least_id.get(k, r[0]), r[0])
    n = {id(r): (links[i], least_id.get(id(find(r)))) for i, r in enumerate(ok)}
    return sorted((-1 if r[0] is None else r[0], *[-1 if x is None else x for x in n.get(id(r), (0, r[0]))]) for r in rows)


def rows_of(rng, groups=25, d=16):
    rows, k = [], 1
    for g in range(groups):
        c = rng.normal(size=d)
        for _ in range(int(rng.integers(1, 6))):
            v = c + rng.normal(size=d) * 0.04 * (g % 3)
            rows.append((k, [float(x) for x in v], 1, 0, "n", 0))
            k += 1
    return rows


def test_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.decode(x)
    assert lattice.shortest_vectors().shape == (240, 8)
    for v in lattice.shortest_vectors():  # no neighbour is nearer
        assert (((x - p) ** 2).sum(1) <= ((x - p - v) ** 2).sum(1) + 1e-9).all()
    assert (p.sum(1) % 2 == 0).all() and ((2 * p) % 1 == 0).all()


def test_links_as_by_brute_force(spark):
    rows = rows_of(np.random.default_rng(5))
    z = rows[0][1]
    rows += [(None, None, 1, 0, "n", 0), (900, [], 1, 0, "n", 0), (901, [0.0] * 16, 1, 0, "n", 0), (902, [float("nan"), *z[1:]], 1, 0, "n", 0), (903, [None, *z[1:]], 1, 0, "n", 0), (904, [float("inf"), *z[1:]], 1, 0, "n", 0)]
    rows += [(905, z, 1, 0, "n", 0), (905, z, 1, 0, "n", 0), (None, z, 1, 0, "n", 0), (906, [2 * x for x in z], 1, 0, "n", 0), (907, z[:5], 1, 0, "n", 0), (908, [-0.0 if k else 1.0 for k in range(16)], 1, 0, "n", 0), (909, [0.0 if k else 1.0 for k in range(16)], 1, 0, "n", 0)]
    got = lattice.near_links(spark.createDataFrame(rows, SCHEMA), tables=8, blocks=1, probes=4, scale=0.9).collect()
    assert sorted((-1 if r["id"] is None else r["id"], r["n_links"], -1 if r["component"] is None else r["component"]) for r in got) == brute(rows)
    assert lattice.near_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tiles_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(7)
    c = rng.normal(size=16)
    rows = [(k, [float(x) for x in c + rng.normal(size=16) * 0.01], 1, 0, "n", 0) for k in range(90)]
    monkeypatch.setattr(lattice, "TILE", 20)
    got = lattice.near_links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["n_links"] == 89 and r["component"] == 0 for r in got)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    for cosine, recall in ((0.952, 0.97), (0.97, 0.99)):
        y = cosine * x + np.sqrt(1 - cosine**2) * z
        rows = [(k, [float(v) for v in u], 1, 0, "n", 0) for k, u in enumerate([*x, *y])]
        got = {r["id"]: r["n_links"] for r in lattice.near_links(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert sum(got.values()) / 3000 >= recall
    for blocks, tables, probes, scale in ((3, *[lattice.grid(10**9)[k] for k in (0, 2, 3)]),):
        keys = [lattice.cell_keys(u, tables, blocks, probes, scale, 11) for u in (x, 0.952 * x + np.sqrt(1 - 0.952**2) * z)]
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(*keys, strict=True)]) >= 0.95


def test_the_query_on_a_table_with_links(spark, tmp_path):
    """The table's own vectors, and beside every third one neighbours at cosines from 0.93 to 0.99; all pairs by numpy."""
    from tessera.llm import queries

    rng = np.random.default_rng(21)
    base = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows = [(i, [float(a) for a in v]) for i, v in base]
    top = max(i for i, _ in base)
    for i, v in base[::3]:
        for c in rng.uniform(0.93, 0.99, 3):
            w = rng.normal(size=len(v))
            w -= w @ v / (v @ v) * v
            top += 1
            rows.append((top, [float(a) for a in c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * w / np.linalg.norm(w)]))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = np.array([np.array(v, np.float32).astype(float) for _, v in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    got = {r["vec_id"]: r for r in queries.op9_lattice(spark, str(tmp_path)).collect()}
    want = int(near.sum()) - len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert want > 500 and 0.97 * want <= found <= want
    assert all(got[i]["n_links"] <= near[k].sum() - 1 and got[i]["kept"] == (got[i]["component_id"] == i) for k, (i, _) in enumerate(rows))


def test_vectors_of_two_lengths_keep_their_links(spark):
    rng = np.random.default_rng(13)
    rows = []
    for d in (64, 128):
        for _ in range(400):
            c = rng.normal(size=d)
            rows += [(len(rows) + k, [float(v) for v in c + rng.normal(size=d) * 0.05 * k], 1, 0, "n", 0) for k in (0, 1)]
    both = {r["id"]: (r["n_links"], r["component"]) for r in lattice.near_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(both[k] == (1, k - k % 2) for k in range(len(rows)))


def test_pairs_as_by_brute_force(monkeypatch):
    rng = np.random.default_rng(2)
    unit = lattice._unit(rng.normal(size=(300, 3)))
    cell = np.sort(rng.integers(0, 12, 300))
    cell[200:] = 20  # a large one
    end = np.searchsorted(cell, cell, side="right")
    begin = np.where(cell == 20, np.where(np.arange(300) < 240, 240, 300), np.arange(300) + 1)
    want = {(i, j) for i in range(300) for j in range(begin[i], end[i]) if unit[i] @ unit[j] >= 0.7}
    for few in (0, 5, 24, 1000):
        monkeypatch.setattr(lattice, "FEW", few)
        got = [(int(a), int(b)) for i, j in lattice._pairs(begin, end, unit, 0.7) for a, b in zip(i, j, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_links_do_not_hang_on_the_number_of_rows(spark, monkeypatch):
    """A table said to be of a billion vectors has the cells of a small one."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=(200, 64))
    y = x + rng.normal(size=x.shape) * 0.33
    rows = spark.createDataFrame([(k, [float(v) for v in u], 1, 0, "n", 0) for k, u in enumerate([*x, *y])], SCHEMA)
    want = {r["id"]: (r["n_links"], r["component"]) for r in lattice.near_links(rows).collect()}
    used, large = [], lattice.grid(10**9)
    monkeypatch.setattr(lattice, "grid", lambda n: used.append(n) or large)
    assert {r["id"]: (r["n_links"], r["component"]) for r in lattice.near_links(rows).collect()} == want and not used
    assert sum(n for n, _ in want.values()) > 100


def test_a_cosine_at_the_threshold_does_not_hang_on_the_cell(monkeypatch):
    rng = np.random.default_rng(32)
    unit = lattice._unit(rng.normal(size=(120, 64)))
    begin, end = np.arange(120) + 1, np.full(120, 120)
    for least in (unit[3] @ unit[50], np.einsum("i,i->", unit[7], unit[90]), np.float64((unit @ unit.T)[20, 70])):
        found = []
        for few in (0, 1000):
            monkeypatch.setattr(lattice, "FEW", few)
            found.append({(int(a), int(b)) for i, j in lattice._pairs(begin, end, unit, least) for a, b in zip(i, j, strict=True)})
        assert found[0] == found[1]
