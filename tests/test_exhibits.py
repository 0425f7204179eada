import random

import pytest
from test_masking import summary

from cohortwise.operators.masking import cohort_warnings
from cohortwise.operators.exhibits import (
    exhibit_mask,
    exhibit_rows,
    exhibit_top_n,
    hierarchy_layout,
    hierarchy_rollup,
    hierarchy_share,
    metric_view,
)


def test_metrics(spark):
    df = summary(spark, {})
    assert metric_view(df, "count").first()["treemap_size_true"] == 1.0
    assert metric_view(df, "amount").first()["treemap_size_true"] == 8e4
    with pytest.raises(ValueError):
        metric_view(df, "both")


def test_clipping(spark):
    df = summary(
        spark,
        {"Dimensions": "Segment=High", "AE_Ratio_Count": 4.2, "AE_Count_CI_Lower": None,
         "AE_Count_CI_Upper": None},
        {"AE_Ratio_Count": None, "AE_Count_CI_Lower": -1.0, "AE_Count_CI_Upper": float("inf")},
    )
    high, none = exhibit_rows(df, "count").orderBy("source_row_number").collect()
    assert high["metric_ratio_true"] == 4.2 and high["metric_ratio_display"] == 3.0
    assert high["metric_ratio_clipped"] and not high["metric_ci_available"]
    assert high["color_value_display"] == 2.0 and high["color_value_saturated"]
    assert none["metric_ratio_display"] is None and not none["metric_ratio_clipped"]
    assert none["metric_ci_lower_display"] == 0.0 and none["metric_ci_lower_clipped"]
    assert none["metric_ci_upper_true"] is None and not none["color_value_saturated"]


def test_labels(spark):
    df = summary(spark, {}, {"Dimensions": "Policy_Number=P001 | Gender=M"},
                 {"Dimensions": "malformed label"}, {"Dimensions": None}, {"Sum_MAC": 0.0})
    rows = exhibit_mask(df).orderBy("cohort_rank").collect()
    assert [r["sanitized_dimensions"] for r in rows] == [
        "Gender=M", "[masked cohort label]", "row_0003", "row_0004", "Gender=M"
    ]
    assert [r["display_label"] for r in rows][1:3] == ["row_0002", "row_0003"]
    assert [r["masking_reason"] for r in rows] == [
        None, "sensitive_or_disallowed_dimension", "dimension_parse_warning",
        "dimension_parse_warning", None,
    ]
    assert rows[2]["hierarchy_parts"] == ["row_0003"] and rows[2]["dimension_columns"] == []
    text = str([r for r in rows])
    assert "Policy_Number" not in text and "P001" not in text
    warned = {(r["evidence_refs"][0], r["code"]) for r in cohort_warnings(df).collect()}
    assert warned == {("row_0002", "sensitive_or_disallowed_dimension"),
                      ("row_0003", "dimension_parse_warning"),
                      ("row_0004", "dimension_parse_warning")}


def test_review_table_is_cut_and_the_tree_is_not(spark):
    df = summary(spark, {"Dimensions": "Segment=A"}, {"Dimensions": "Segment=B", "Sum_MEC": 3.0},
                 {"Dimensions": "Segment=C", "Sum_MEC": 5.0})
    rows = exhibit_rows(df, "count")
    top = exhibit_top_n(rows, 2).orderBy("visual_rank").collect()
    assert [r["sanitized_dimensions"] for r in top] == ["Segment=A", "Segment=B"]
    nodes = hierarchy_rollup(rows).orderBy("first_rank").collect()
    assert [r["size"] for r in nodes] == [1.0, 3.0, 5.0]


def test_tree_ratios(spark):
    df = summary(
        spark,
        {"Dimensions": "a=1 | b=1", "Sum_MEC": 2.0, "Sum_MAC": 4.0},
        {"Dimensions": "a=1 | b=2", "Sum_MEC": 6.0, "Sum_MAC": 4.0},
        {"Dimensions": "a=2 | b=1", "Sum_MEC": 0.0, "AE_Ratio_Count": 1.0},
        {"Dimensions": "a=2 | b=1", "Sum_MEC": -4.0, "AE_Ratio_Count": 2.0},
        {"Dimensions": "a=3", "Sum_MEC": None, "AE_Ratio_Count": None},
    )
    nodes = {tuple(r["path"]): r for r in hierarchy_rollup(exhibit_rows(df, "count")).collect()}
    top = nodes[("a=1",)]
    assert (top["size"], top["actual"], top["expected"], top["ratio"]) == (8.0, 8.0, 8.0, 1.0)
    assert top["depth"] == 1 and top["parent"] == []
    empty = nodes[("a=2", "b=1")]
    assert empty["size"] == 0.0 and empty["ratio"] == 1.5 and empty["parent"] == ["a=2"]
    assert nodes[("a=3",)]["ratio"] is None and nodes[("a=3",)]["first_rank"] == 5


def test_shares(spark):
    rng = random.Random(4)
    # one parent holds most children; another has only empty ones
    labels = [f"a=hot | b={i}" for i in range(60)] + [f"a=none | b={i}" for i in range(4)] + [
        f"a={i % 5} | b={i}" for i in range(20)
    ]
    rng.shuffle(labels)
    sizes = [0.0 if "none" in label else float(rng.randint(0, 9)) for label in labels]
    df = summary(spark, *[{"Dimensions": d, "Sum_MEC": s} for d, s in zip(labels, sizes)])
    got = hierarchy_share(hierarchy_rollup(exhibit_rows(df, "count")), slices=6).collect()
    placed = {tuple(r["path"]): r for r in got}
    for parent in {p[:-1] for p in placed}:
        children = sorted((r for p, r in placed.items() if p[:-1] == parent),
                          key=lambda r: r["first_rank"])
        total = sum(r["size"] for r in children)
        cursor = 0.0
        for r in children:
            share = r["size"] / total if total else 1 / len(children)
            assert r["share"] == pytest.approx(share) and r["offset"] == pytest.approx(cursor)
            assert r["axis"] == ("width" if not parent else "height")
            cursor += share
        assert cursor == pytest.approx(1.0)


def _areas(tree, x, y, width, height, depth=0):
    """Leaf rectangles by walking a tree of {label: (size, children)}."""
    sizes = {k: size for k, (size, _) in tree.items()}
    total = sum(sizes.values())
    weights = sizes if total > 0 else dict.fromkeys(sizes, 1.0)
    total = sum(weights.values())
    out, at = {}, x if depth % 2 == 0 else y
    for label, (_, children) in tree.items():
        part = weights[label] / total
        box = (at, y, width * part, height) if depth % 2 == 0 else (x, at, width, height * part)
        at += box[2] if depth % 2 == 0 else box[3]
        inner = _areas(children, *box, depth + 1) if children else {(): box}
        out |= {(label, *tail): b for tail, b in inner.items()}
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_leaf_rectangles(spark, depth):
    rng = random.Random(depth)
    paths = sorted({tuple(f"{'abcd'[d]}={rng.randint(0, 3)}" for d in range(depth)) for _ in range(25)})
    # Some end early, so leaves lie at several depths; one branch has no size at all.
    paths += [tuple(f"{'abcd'[d]}=short{d}" for d in range(k)) for k in range(1, depth)]
    paths += [("a=none", *[f"{'bcd'[d]}={i}" for d in range(depth - 1)]) for i in range(3 if depth > 1 else 1)]
    rng.shuffle(paths)
    sizes = [0.0 if p[0] == "a=none" else float(rng.randint(0, 9)) for p in paths]
    df = summary(spark, *[{"Dimensions": " | ".join(p), "Sum_MEC": s} for p, s in zip(paths, sizes)])
    tree = {}
    for path, size in zip(paths, sizes):
        here = tree
        for part in path:
            held, children = here.get(part, (0.0, {}))
            here[part] = (held + size, children)
            here = children
    want = _areas(tree, 10.0, 20.0, 300.0, 200.0)
    nodes = hierarchy_rollup(exhibit_rows(df, "count"))
    for slices in (None, 5):
        rows = hierarchy_layout(nodes, area=(10.0, 20.0, 300.0, 200.0), slices=slices).collect()
        got = {tuple(r["path"]): (r["x"], r["y"], r["width"], r["height"]) for r in rows}
        assert set(got) == set(want)
        for path, box in want.items():
            assert got[path] == pytest.approx(box, abs=1e-9)
        assert sum(w * h for _, _, w, h in got.values()) == pytest.approx(300.0 * 200.0)


def test_no_nodes_have_no_rectangles(spark):
    rows = exhibit_rows(summary(spark, {}), "count").where("false")
    assert hierarchy_layout(hierarchy_rollup(rows)).collect() == []
