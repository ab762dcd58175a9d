"""Quantities in different units."""

import itertools
import math
import random

import pytest

from vitagraph.operators import units as U

MEASURES = [
    ("body_temperature", "temperature|temp|temperatura|体温", "°C", None),
    ("body_weight", "weight|peso", "kg", None),
    ("lesion_size", "lesion|cyst|lesão|病変", "mm", None),
    ("glucose", "glucose|glucemia", "mg/dL", 180.16),
    ("creatinine", "creatinine", "mg/dL", 113.12),
    ("systolic_pressure", "blood pressure|BP", "mmHg", None),
    ("diastolic_pressure", "blood pressure|BP", "mmHg", None),
    ("carcinoembryonic_antigen", "CEA|ACE", "ng/mL", None),
    ("fluid_volume", "ascites|blood loss", "mL", None),
]
R = U.reader(tuple(MEASURES))
TEXTS = [
    ("Body temperature rose to 103.4 degrees Fahrenheit on day 6.", [("body_temperature", 397)]),
    ("The weight was 200 lb at admission.", [("body_weight", 907)]),
    ("The cyst measured 4.5x1.2x0.4 cm and lay 7 cm below the spleen.", [("lesion_size", 450), ("lesion_size", 120), ("lesion_size", 40)]),
    ("A 0.9-cm cyst (Fig. 8) compressed the retina. No weight loss for 3 weeks.", [("lesion_size", 90)]),
    ("The lesion measured nine centimetres.", [("lesion_size", 900)]),
    ("A cyst of 107 mmx4 mm was excised", [("lesion_size", 1070), ("lesion_size", 40)]),
    ("Glucemia: 14,0 mmol/L al ingreso", [("glucose", 2522)]),
    ("Creatinine reached 0.7mg/dl (normal 0.6-1.2 mg/dL) on day 3.", [("creatinine", 7)]),
    ("Creatinine = 179 umol/L; urea unchanged", [("creatinine", 20)]),
    ("BP was 14.1/10.2 kilopascal with a pulse of 63.", [("systolic_pressure", 1058), ("diastolic_pressure", 765)]),
    ("ACE : 1 414,3 μg/L à l'entrée", [("carcinoembryonic_antigen", 14143)]),
    ("CEA: 2.601,8 ng/mL al ingreso", [("carcinoembryonic_antigen", 26018)]),
    ("CEA was 2,568.5 ng per ml", [("carcinoembryonic_antigen", 25685)]),
    ("7日目のCEAは57.85 ug/dl。体温は37.9°C。", [("carcinoembryonic_antigen", 5785), ("body_temperature", 379)]),
    ("In total 0.3 litres of blood loss was recorded", [("fluid_volume", 3000)]),
    ("The tumor board met on day 7. Weight loss lasted 3 months.", []),
    ("", []),
]


@pytest.mark.parametrize("text,want", TEXTS)
def test_stated_values(text, want):
    assert sorted((m, U.tenths(v)) for m, _, v, _ in R.read(text)) == sorted(want)


def test_numbers():
    assert U.read_number("1,234.5", False) == U.read_number("1.234,5", True) == 1234.5
    assert U.read_number("2.396", True) == 2396 and U.read_number("2.396", False) == 2.396
    assert U.read_number("0,741", True) == U.read_number("0.741", False) == 0.741
    assert U.ambiguous("1,500") and not U.ambiguous("12.5")


def test_changepoints_are_optimal():
    def cost(v):
        m = sum(v) / len(v)
        return sum((x - m) ** 2 for x in v)

    rng = random.Random(4)
    for n in range(1, 9):
        for _ in range(20):
            values = [rng.choice([0, 2, 5]) + rng.random() for _ in range(n)]
            best = min(
                sum(cost(values[a:b]) for a, b in zip((0, *cut), (*cut, n))) + 0.7 * len(cut)
                for k in range(n) for cut in itertools.combinations(range(1, n), k)
            )
            starts = U.changepoints(values, 0.7)
            got = sum(cost(values[a:b]) for a, b in zip(starts, (*starts[1:], n))) + 0.7 * (len(starts) - 1)
            assert math.isclose(best, got, abs_tol=1e-9)
    assert U.changepoints([], 1.0) == []


def ways_of(name):
    return [m for m in R.measures if m.name == name][0].ways()


def test_level_shift_is_reversed():
    ways = ways_of("glucose")
    found = U.resolve_history([[209.0]], [(["11.6"], ways), (["209"], ways)], {"209": {209.0}})
    assert found[1] == [209.0] and abs(found[0][0] - 209.0) < 1
    assert U.resolve_history([[209.0]], [(["3.0"], ways)], {"209": {209.0}}) == [None]
    assert U.resolve_history([], [(["3.0"], ways)], {}) == [None]


def test_an_event_has_one_unit():
    found = U.resolve_history([[45.0, 12.0, 4.0]], [(["4.5", "1.2", "0.4"], ways_of("lesion_size")), (["45", "12", "4"], ways_of("lesion_size"))], {})
    assert found == [[45.0, 12.0, 4.0], [45.0, 12.0, 4.0]]


def test_history_without_the_search(monkeypatch):
    """Histories of many sources whose recorded units change: cut at the changes, the
    shifts are reversed; uncut, only the values in the common unit are right."""
    rng, right = random.Random(12), {True: 0, False: 0}
    ways, factors = ways_of("body_weight"), (1.0, 1000.0, 1 / 0.45359237)
    cases = []
    for _ in range(60):
        weight = rng.uniform(45, 110)
        stated = [[round(weight * rng.uniform(0.97, 1.03), 1)] for _ in range(3)]
        units = [f for f in rng.sample(factors, 3) for _ in range(rng.randint(1, 3))]
        values = [rng.choice(stated)[0] for _ in units]
        cases.append((stated, [([f"{v * f:.1f}"], ways) for v, f in zip(values, units)], values))
    for search in (True, False):
        if not search:
            monkeypatch.setattr(U, "changepoints", lambda values, penalty: [0])
        for stated, recorded, values in cases:
            found = U.resolve_history(stated, recorded, {})
            right[search] += sum(x is not None and abs(x[0] - v) < 0.1 for x, v in zip(found, values))
    total = sum(len(v) for _, _, v in cases)
    assert right[True] > 0.95 * total and right[False] < 0.5 * total


def test_rows(spark):
    cases = spark.createDataFrame(
        [(1, "a_1", "Fasting glucose was 11.6 mmol/L."), (2, "a_1", "Fasting glucose was 11.6 mmol/L."), (3, "b_1", None), (4, "c_1", ""), (5, None, "weight 5 kg")],
        "row_id bigint, case_id string, case_text string",
    )
    nodes = spark.createDataFrame(
        [(1, "R:glucose", "Glucose ", "Result", "value=11.6", "a_1"), (2, "R:glucose", None, "Result", "value=11.6; unit=mmol/L", "b_1"),
         (3, "R:bp", "BP (kPa)", "Result", "value=14.1/10.2", "b_1"), (4, "R:weight", "weight", "Result", "value=2,600; unit=g", None),
         (5, "R:weight", "weight loss", "Symptom", "value=3", "a_1"), (6, None, None, None, None, None), (7, "R:glucose", "glucose", "Result", "value=99", "c_1"),
         (8, "R:temp", "temp", "Result", "body_temperature=98.6 °F", "z_1")],
        "row_id bigint, node_id string, label string, type string, attributes string, case_id string",
    )
    measures = spark.createDataFrame(MEASURES, "measure string, spoken_names string, common_unit string, molar_mass double")
    got = {(r.src, r.row_id, r.measure, U.tenths(r.value)) for r in U.measured_values(cases, nodes, measures).collect()}
    assert got == {
        ("cases", 1, "glucose", 2090), ("cases", 2, "glucose", 2090), ("cases", 5, "body_weight", 50), ("v4_nodes", 1, "glucose", 2090),
        ("v4_nodes", 2, "glucose", 2090), ("v4_nodes", 3, "systolic_pressure", 1058), ("v4_nodes", 3, "diastolic_pressure", 765), ("v4_nodes", 4, "body_weight", 26),
        ("v4_nodes", 8, "body_temperature", 370),
    }
    assert U.measured_values(cases.limit(0), nodes.limit(0), measures).count() == 0
