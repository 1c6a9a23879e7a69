"""Search by trigram postings, against the plain search."""

import pytest

from tallyframe.operators import explore, postings

VALUES = ["Office of the Mayor", "ÉCOLE normale", "100% grant", "a_b", "x😀y😀z", "İstanbul", "ab", "", None, "back\\slash's", "line\nbreak"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(VALUES[i % 11] if i % 3 else "hot value", f"agency {i % 40:04d}", VALUES[(i // 11) % 11], None if i % 5 else f"d{i % 17}", i)
            for i in range(2000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in explore.SEARCH_COLUMNS) + ", id long")
    return df, postings.build(df, str(tmp_path_factory.mktemp("postings")), blocks=16)


@pytest.mark.parametrize("needle", ["mayor", "ÉCOLE", "école", "100%", "a_b", "😀y😀", "x😀y", "i̇st", "ab", "y 0039", "hot", "no such text",
                                    "\\sla", "h's", "ne\nbr", "  Mayor  ", "", None, "d16", "agency", "e o"])
def test_same_rows_as_the_plain_search(index, needle):
    df, held = index
    got, want = held.search(needle), explore.search(df, needle)
    assert got.columns == df.columns
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_files_are_skipped(index):
    df, held = index
    blocks, lower = held.blocks("agency 0039"), {}
    for r in held.rows.collect():
        lower.setdefault(r[postings.BLOCK], set()).update((r[c] or "").lower() for c in explore.SEARCH_COLUMNS)
    grams = {"agency 0039"[i:i + 3] for i in range(9)}
    assert blocks == sorted(k for k, values in lower.items() if all(any(g in v for v in values) for g in grams))
    assert 0 < len(blocks) < len(lower) and held.blocks("no such text") == []
    assert held.blocks("ab") is None and held.blocks("agency") == sorted({r[0] for r in held.rows.select(postings.BLOCK).distinct().collect()})
    plan = held.search("agency 0039")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" + postings.BLOCK in plan.replace("cast(", "") or f"PartitionFilters: [isnotnull({postings.BLOCK}" in plan


def test_a_shared_value_is_spread(index):
    _, held = index
    sizes = [r["count"] for r in held.rows.groupBy(postings.BLOCK).count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 300


def test_wildcards_and_empty_tables(spark, index, tmp_path):
    df, held = index
    assert held.search("a_enc", wildcards=True).count() == explore.search(df, "a_enc", wildcards=True).count() == 2000
    none = postings.build(df.where("id < 0"), str(tmp_path / "none"))
    assert none.search("mayor").collect() == [] == none.search("ab").collect()
