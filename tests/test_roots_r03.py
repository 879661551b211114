"""Pointer jumping: only parents jump, and cycles end it when nobody gets on."""

from __future__ import annotations

from ledgerloom.operators import entities
from ledgerloom.operators.entities import roots


def test_cycles_end_the_rounds_and_only_parents_jump(spark, monkeypatch):
    written = []
    cut = entities.cut

    def counted(df, name, *rest):
        table = cut(df, name, *rest)
        written.append(table.count())
        return table

    monkeypatch.setattr(entities, "cut", counted)
    chain = [(f"c{k}", f"c{k - 1}" if k else None) for k in range(40)]
    leaves = [(f"leaf{k}", "c39") for k in range(100)] + [("alone", None)]
    rows = chain + leaves + [("x", "y"), ("y", "x"), ("above", "x"), ("over", "above"), ("self", "self"), ("s", "unknown"), ("t", "s")]
    found = {r.customer: r.ultimate_parent for r in roots(spark.createDataFrame(rows, "customer string, parent string")).collect()}
    expect = {c: "c0" for c, _ in chain + leaves} | {"alone": "alone", "s": "unknown", "t": "unknown"}
    assert found == expect
    # 39 steps need six rounds and one more shows that the rest is cycles; 40 parents of the chain, x, y, above, self, s, unknown.
    assert len(written) <= 8 and set(written) == {46}
