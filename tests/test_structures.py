"""Structures: what is one, and one text for all its spellings."""

import random

import pytest
from pyspark.sql import functions as F

from corundum.functions import smiles
from corundum.operators import evidence, visual

#: Spellings of one structure each.
SAME = [
    ("CCO", "OCC", "C(O)C", "[CH3][CH2][OH]"),
    ("c1ccccc1", "C1=CC=CC=C1", "C=1C=CC=CC=1", "c1ccc:cc1"),
    ("Cc1ccccc1C", "CC1=C(C)C=CC=C1", "CC1=CC=CC=C1C"),
    ("c1ccc2cccc2cc1", "C1=CC=C2C=CC=C2C=C1"),
    ("COC(=O)Nc1nc2ccccc2[nH]1", "COC(=O)NC1=NC2=CC=CC=C2N1", "O(C)C(Nc1[nH]c2c(n1)cccc2)=O"),
    ("Cn1cnc2c1c(=O)n(C)c(=O)n2C", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C"),
    ("c1ccc(-c2ccccc2)cc1", "c1ccccc1c1ccccc1", "C1=CC=CC=C1C1=CC=CC=C1"),
    ("N[C@@H](C)C(=O)O", "OC(=O)[C@H](C)N", "C[C@H](N)C(=O)O", "[C@H](N)(C)C(O)=O"),
    ("[O-][N+](=O)c1ccccc1", "O=[N+]([O-])C1=CC=CC=C1"),
    ("C[C@H]1CC[C@@H](C)CC1", "C1C[C@@H](C)CC[C@H]1C"),
    ("[Na+].[Cl-]", "[Cl-].[Na+]"),
    ("CC(C)(O)F", "C[C@](C)(O)F", "F[C@@](C)(O)C"),
    ("C%11CC%11", "C1CC1"),
]
#: Texts that differ from each other in the structure.
OTHERS = ["CCO", "CCN", "COC", "C=CO", "N[C@@H](C)C(=O)O", "N[C@H](C)C(=O)O", "NC(C)C(=O)O", "[13CH4]", "C", "[2H]C", "c1ccncc1", "C1CCNCC1", "C[N+](C)(C)C", "O=C1C=CC(=O)C=C1", "Oc1ccc(O)cc1", "[CH3:1]C", "[CH2]C", "c1ccsc1", "c1cc[nH]c1"]
BROKEN = [
    "", " ", "C(", "C)", "CC(C", "C1CC", "C1CC2", "=C", "C=", "C==C", "C.", ".C", "()", "C()C", "(C)C", "C11", "C12CC12", "[Xx]", "[C", "C]", "[]", "Cq", "C(C)(C)(C)(C)C", "N(C)(C)(C)C", "O(C)(C)C", "F(C)C",
    "c1cccc1", "n1cccc1", "c1ccccc1=O", "cc", "C=1CC-1", "[O-](C)C", "[NH4+]C", "C%1", "1CC1", "*", "C*",
]


def renumbered(text, rng):
    g = smiles.Graph(smiles.parse(text))
    ranks = list(range(len(g.atoms)))
    rng.shuffle(ranks)
    return g.write(ranks)


@pytest.mark.parametrize("texts", SAME)
def test_spellings_of_one_structure(texts):
    found = {smiles.read(t) for t in texts}
    assert len(found) == 1 and found.pop()[0] == "valid"


def test_structures_that_differ():
    assert len({smiles.read(t)[1] for t in OTHERS}) == len(OTHERS)
    assert all(smiles.read(t)[0] == "valid" for t in OTHERS)


@pytest.mark.parametrize("text", BROKEN)
def test_what_is_no_structure(text):
    status, form, problem = smiles.read(text)
    assert status == "invalid" and form is None and problem


def test_renumbering_and_restarts():
    """A structure's atoms in any order, and its canonical text read again."""
    rng = random.Random(7)
    texts = [t for group in SAME for t in group] + OTHERS + ["CC1(C)S[C@@H]2[C@H](NC(=O)Cc3ccccc3)C(=O)N2[C@H]1C(=O)O", "C12C3C4C1C5C2C3C45", "c1cc2ccc3cccc4ccc(c1)c2c34", "CC(C)(C)c1ccc2c(c1)Cc1ccccc1-2", "C" * 400 + "N"]
    for t in texts:
        form = smiles.read(t)[1]
        assert smiles.read(form)[1] == form
        for _ in range(25 if len(t) < 100 else 2):
            assert smiles.read(renumbered(t, rng))[1] == form, t


def random_structure(rng):
    """A tree with some rings and double bonds, and how many bonds each atom has."""
    atoms = [rng.choice("CCCCNOS") for _ in range(rng.randint(2, 14))]
    most = {"C": 4, "N": 3, "O": 2, "S": 2}
    left = [most[a] for a in atoms]
    bonds = {}
    for k in range(1, len(atoms)):
        with_room = [j for j in range(k) if left[j]]
        if not with_room:
            return None
        j = rng.choice(with_room)
        order = rng.randint(1, min(left[j], left[k], 2))
        bonds[j, k] = order
        left[j], left[k] = left[j] - order, left[k] - order
    for _ in range(rng.randint(0, 2)):
        j, k = sorted(rng.sample(range(len(atoms)), 2))
        if left[j] and left[k] and (j, k) not in bonds:
            bonds[j, k] = 1
            left[j], left[k] = left[j] - 1, left[k] - 1
    return atoms, bonds


def spell(atoms, bonds, rng):
    """The graph as text, from a random atom, its branches in random order."""
    near = {a: [] for a in range(len(atoms))}
    for (a, b), order in bonds.items():
        near[a].append((b, order))
        near[b].append((a, order))
    seen, used, rings = set(), set(), {}

    def visit(a):
        seen.add(a)
        for b, order in rng.sample(near[a], len(near[a])):
            if b not in seen:
                used.add((min(a, b), max(a, b)))
                tree[a].append((b, order))
                visit(b)

    tree = {a: [] for a in near}
    start = rng.randrange(len(atoms))
    visit(start)
    closing = {a: "" for a in near}
    for n, (a, b) in enumerate(sorted(set(bonds) - used), 1):
        rings[a, b] = n
        for x in (a, b):
            closing[x] += ("=" if bonds[a, b] == 2 else "") + str(n)

    def text(a):
        parts = [("=" if order == 2 else "") + text(b) for b, order in tree[a]]
        return atoms[a] + closing[a] + "".join(f"({p})" for p in parts[:-1]) + "".join(parts[-1:])

    return text(start)


def test_random_graphs_spelled_at_random():
    rng = random.Random(11)
    n = 0
    while n < 300:
        made = random_structure(rng)
        if made:
            n += 1
            assert len({smiles.read(spell(*made, rng))[1] for _ in range(6)}) == 1, spell(*made, rng)


def test_column_and_validity(spark):
    df = spark.createDataFrame([("OCC",), ("C1CC",), (None,), ("F/C=C/F",), ("CCO",)], "s string")
    got = df.select("s", smiles.structure(F.col("s")).alias("x"), visual.validity(visual.clean_smiles(F.col("s"))).alias("v")).collect()
    assert [(r.x.status, r.v) for r in got] == [("valid",) * 2, ("invalid",) * 2, ("invalid",) * 2, ("valid",) * 2, ("valid",) * 2]
    assert got[0].x.canonical == got[4].x.canonical and got[3].x.canonical == "F/C=C/F" and got[1].x.canonical is None


def test_two_spellings_are_no_conflict(spark):
    rows = [("d", f"e{k}", "6a", f"Chemical structure | smiles={s} | source", None, "chemical_structure_smiles", 0.9) for k, s in enumerate(["COC(=O)Nc1nc2ccccc2[nH]1", "COC(=O)NC1=NC2=CC=CC=C2N1"])]
    found = evidence.structures(spark.createDataFrame(rows, "doc_id string, evidence_id string, caption string, text string, metadata string, source_type string, confidence double"))
    assert found.select("canonical_smiles").distinct().count() == 1 and found.select("smiles").distinct().count() == 2
