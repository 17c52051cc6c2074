import pytest

from lodestrata.llm.canonical import edits
from lodestrata.llm.variants import alike_names, average_linkage, clusters, components, grams, near_cores, read, same_pairs, similarity, spelled

ENTRIES = [("Law", ["Droit"]), ("Sport", []), ("Wound Care", ["Dressing Practice"])]


@pytest.mark.parametrize("kind,names", [
    ("PERSON", ["Victoria N. Truplinokuk", "Truplinokuk, Victoria", "Prof. Victoria Truplinokuk", "VICTORIA TRUPLINOKUK", "Victoria Truplinokuk, PhD"]),
    ("ORG", ["Verelayak Nutrition Laboratory", "The Verelayak Nutrition Laboratory", "Lab. of Nutrition Verelayak",
             "Laboratory of Nutrition, Verelayak", "Verelayak Nutrition Laboratory (VNL)", "verelayak  nutrition lab."]),
    ("CONCEPT", ["Inverse Vipegriril Ratio", "Vipegriril’s inverse ratio", "Vipegriril Ratio, inverse", "the Inverse-Vipegriril Ratio (IVR)"]),
    ("TECHNOLOGY", ["Krogegejik Controller", "Controller: Krogegejik", "Krogegejik-Controller", "Krogegejik™ Controllers",
                    "KrogegejikController", "Krogegejik Controller (device)"]),
    ("LOCATION", ["Lake Zatithebok", "L.Zatithebok", "Zatithebok, Lake", "lake of zatithebok", "Lake Zatithebok (town)"]),
    ("EVENT", ["11th Lejahudin Congress", "Lejahudin Congress XI", "Lejahudin Congress #11", "Eleventh Lejahudin Congress",
               "Congress No. 11, Lejahudin", "The 11th Lejahudin Congress", "Lejahudin Congress (11th)"])])
def test_forms_of_a_name_read_alike(kind, names):
    assert len({read(n, kind) for n in names}) == 1, [read(n, kind) for n in names]


@pytest.mark.parametrize("kind,a,b,same", [
    ("PERSON", "Vicky Bafeitrefil", "V. Bafeitrefil", True), ("PERSON", "Vera Bafeitrefil", "Victoria Bafeitrefil", False),
    ("PERSON", "Ted Bafeitrefil", "Edward Bafeitrefil", True), ("PERSON", "Dick Bafeitrefil", "Richard Bafeitrefli", True),
    ("ORG", "Yotisufen SI", "Yotisufen Seismology Institute", True), ("ORG", "Yotisufen OI", "Yotisufen Seismology Institute", False),
    ("ORG", "Yotisufen Seism. Inst.", "Yotisufen Seismology Institute", True), ("EVENT", "5th Xavomil Forum", "6th Xavomil Forum", False),
    ("CONCEPT", "Inve. Tepigetik Ratio", "Inverse Tepigettik Ratio", True), ("LOCATION", "Ft. Grefamotru", "Port Grefamotru", False)])
def test_similarity(kind, a, b, same):
    s = similarity((*read(a, kind), None), (*read(b, kind), None), kind)
    assert (s is not None and s >= .5) == same
    assert similarity((*read(a, kind), "Law"), (*read(a, kind), "Sport"), kind) is None


def test_alike_names_against_brute_force(spark):
    import math
    import random

    rng = random.Random(6)
    part = lambda: "".join(rng.choice(["ka", "lo", "mi", "ren", "tus", "vo"]) for _ in range(rng.randint(1, 3)))
    names = sorted({" ".join(part() for _ in range(rng.randint(1, 3))) for _ in range(200)})
    df = spark.createDataFrame([(i, "A", n) for i, n in enumerate(names)] + [(1000 + i, "B", n) for i, n in enumerate(names[:20])],
                               "name_id long, type string, name string")
    held = {i: {("A", g) for g in grams(n)} for i, n in enumerate(names)} | {1000 + i: {("B", g) for g in grams(n)} for i, n in enumerate(names[:20])}
    often = {}
    for v in held.values():
        for g in v:
            often[g] = often.get(g, 0) + 1
    weight = {g: math.log1p(len(held) / n) for g, n in often.items()}
    unit = {i: math.sqrt(sum(weight[g] ** 2 for g in v)) for i, v in held.items()}
    want = {(a, b) for a in held for b in held if a < b and sum(weight[g] ** 2 for g in held[a] & held[b]) / unit[a] / unit[b] >= .6}
    assert {(r.a, r.b) for r in alike_names(df, .6).collect()} == want and len(want) > 20


def test_words_in_any_order_are_one_spelling():
    assert spelled("smith", "john") == spelled("john", "smith") and spelled("a", "b.\x01c") == "a b c"


def test_linkage_against_the_plain_way():
    import random

    rng = random.Random(2)
    for _ in range(30):
        nodes = [(rng.choice(["abcdefgh", "abcdefgx", "abcdxfgh", "zzzdefgh"]), (rng.choice(["", "v", "vera", "victoria", "vic"]),), rng.choice([None, None, "Law", "Sport"]))
                 for _ in range(9)]
        weights = [rng.randint(1, 4) for _ in nodes]
        assert average_linkage(nodes, weights, "PERSON", .5) == _plain_linkage(nodes, weights, "PERSON", .5)


def _plain_linkage(nodes, weights, kind, least):
    groups = {i: [i] for i in range(len(nodes))}
    alike = lambda i, j: similarity(nodes[max(i, j)], nodes[min(i, j)], kind)
    while True:
        found = []
        for i in groups:
            for j in groups:
                if i < j:
                    s = [(alike(a, b), weights[a] * weights[b]) for a in groups[i] for b in groups[j]]
                    if all(x is not None for x, _ in s):
                        mass = [sum(weights[a] for a in groups[k]) for k in (i, j)]
                        found.append((sum(x * w for x, w in s) / mass[0] / mass[1], sum(mass), -i, -j))
        top = max(found, default=(0,))[0]
        if not found or top < least:
            break
        _, _, i, j = max((f for f in found if f[0] >= top - 1e-9), key=lambda f: f[1:])
        groups[-i] += groups.pop(-j)
    out = [0] * len(nodes)
    for k, members in groups.items():
        for m in members:
            out[m] = k
    return out


def test_average_linkage_keeps_contradictions_apart():
    nodes = [("abcdefgh", ("v",), None), ("abcdefgh", ("vera",), None), ("abcdefgh", ("victoria",), None), ("abcdefgh", ("victoria",), "Law")]
    label = average_linkage(nodes, [1, 1, 1, 5], "PERSON", .5)
    assert label[2] == label[3] == label[0] != label[1]
    assert average_linkage(nodes[:1], [1], "PERSON", .5) == [0]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (50, 3)], "a long, b long")
    got = {}
    for r in components(links).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert got == {1: {*range(1, 41), 50}, 100: {100, 101, 102}}


def test_clusters(spark):
    rows = [(1, "Vicky Truplinokuk", "PERSON", "Law"), (2, "Truplinokuk, V.", "PERSON", "LAW!"), (3, "Victoria Truplinokku", "PERSON", "droit"),
            (4, "Victoria Truplinokuk", "PERSON", "Sport"), (5, "Bruno Truplinokuk", "PERSON", "Law"), (6, None, "PERSON", "Law"),
            (7, "  ", "PERSON", "Law"), (8, "Victoria Truplinokuk", None, "Law"), (9, "Victoria Truplinokuk", "ORG", "Law"),
            (10, "x" * 20_000, "ORG", None), (11, "5th Xavomil Forum", "EVENT", "tbd"), (12, "Xavomil Forum V", "EVENT", ""),
            (13, "6th Xavomil Forum", "EVENT", None), (1, "Vicky Truplinokuk", "PERSON", "Law")]
    df = spark.createDataFrame(rows, "entity_id long, name string, type string, domain string").selectExpr("*", "1 AS cluster", "2 AS core")
    pairs = sorted(map(tuple, same_pairs(clusters(df, ENTRIES)).collect()))
    assert pairs == [(1, 2), (1, 3), (2, 3), (11, 12)]
    assert same_pairs(clusters(df.limit(0), ENTRIES)).count() == 0
    rows = [(1, "John Truplinokuk", "PERSON", "Law"), (2, "Truplinokuk John", "PERSON", None), (3, "Truplinokku John", "PERSON", None)]
    assert same_pairs(clusters(spark.createDataFrame(rows, df.select("entity_id", "name", "type", "domain").schema), ENTRIES)).count() == 3
    cores = spark.createDataFrame([(1, "A", "truplinokuk"), (2, "A", "truplinokku"), (3, "B", "truplinokuk"), (4, "A", "gestuvriyak")],
                                  "core_id long, type string, core string")
    assert [tuple(r) for r in near_cores(cores).collect()] == [(1, 2)]


def test_two_edits_far_apart_are_linked(spark):
    pairs = [("birzoinuwi", "brizoinuuwi"), ("wifeikarren", "wyfeikraren"), ("abcdefg", "bacdegf")]
    cores = spark.createDataFrame([(2 * i + k, "PERSON", c) for i, p in enumerate(pairs) for k, c in enumerate(p)], "core_id long, type string, core string")
    assert {tuple(r) for r in near_cores(cores).collect()} == {(0, 1), (2, 3), (4, 5)}


def _shuffled(spark, run):
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before, most = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        got = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    return got, written() - before


def test_candidates_are_not_shuffled(spark):
    import itertools

    parts = ["kalomi", "rentus", "vobeda", "gupefi", "zanoku", "tirelu", "sogamo", "hupide"]
    names = sorted(" ".join(sorted(x)) for x in itertools.combinations([a + b for a in parts[:4] for b in parts[4:]] + parts, 3))
    df = spark.createDataFrame([(i, "A", n) for i, n in enumerate(names)], "name_id long, type string, name string")
    got, size = _shuffled(spark, lambda: {(r.a, r.b) for r in alike_names(df, .75).collect()})
    assert len(got) > 1000 and size < 300 * len(names), (size, len(names), len(got))


def test_cores_without_a_near_one_are_not_shuffled(spark):
    import random

    rng = random.Random(4)
    cores = sorted({"".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 6))) for _ in range(4000)})
    cores += [c[:i] + c[i + 1:] for c in cores[:40] for i in (1, 2)]
    cores += [c[1] + c[0] + c[2:] + "x" for c in cores[:40]]
    cores = sorted(set(cores))
    df = spark.createDataFrame([(i, "A", c) for i, c in enumerate(cores)] + [(100_000 + i, "B", c) for i, c in enumerate(cores[::7])], "core_id long, type string, core string")
    got, size = _shuffled(spark, lambda: [tuple(r) for r in near_cores(df).collect()])
    most = lambda a, b: 0 if min(len(a), len(b)) < 4 else 1 if min(len(a), len(b)) < 7 else 2
    sides = [(0, cores), (100_000, cores[::7])]
    want = {(k + i, k + j) for k, x in sides for i in range(len(x)) for j in range(i + 1, len(x))
            if abs(len(x[i]) - len(x[j])) <= 2 and len(set(x[i]) ^ set(x[j])) <= 4 and most(x[i], x[j]) and edits(x[i], x[j], most(x[i], x[j])) <= most(x[i], x[j])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert size < 300 * len(cores), (size, len(cores))


def test_counts_that_are_not_broadcast_and_blocks_give_the_same_pairs(spark):
    import random

    rng = random.Random(9)
    part = lambda: "".join(rng.choice(["ka", "lo", "mi", "ren", "tus", "vo"]) for _ in range(rng.randint(1, 3)))
    names = sorted({" ".join(part() for _ in range(rng.randint(1, 3))) for _ in range(400)})
    df = spark.createDataFrame([(i, "AB"[i % 2], n) for i, n in enumerate(names)], "name_id long, type string, name string")
    want = sorted((r.a, r.b, round(r.cosine, 9)) for r in alike_names(df, .6).collect())
    assert len(want) > 20 and len({x[:2] for x in want}) == len(want)
    for more in ({"known": 0}, {"block": 4}, {"known": 0, "block": 3}):
        assert sorted((r.a, r.b, round(r.cosine, 9)) for r in alike_names(df, .6, **more).collect()) == want
    assert alike_names(df.limit(0), .6).count() == 0 and alike_names(df.limit(0), .6, known=-1).count() == 0


def test_a_large_group_of_alike_names_gives_each_pair_once(spark):
    names = [(i, "A", f"vobedakalomi {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(600)]
    df = spark.createDataFrame(names, "name_id long, type string, name string")
    for block in (8192, 250):
        got = [(r.a, r.b) for r in alike_names(df, .1, block=block).collect()]
        assert len(got) == len(set(got)) == 600 * 599 // 2 and all(a < b for a, b in got)
