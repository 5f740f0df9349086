"""Wiki pages: a small graph in both locales as text, refusals, numbers and parents."""

import hashlib

import pytest

from weft.operators import pages as P

REF = "struct<commit_sha: string, path: string, symbol_id: string, start_line: int, end_line: int, content_hash: string>"
MAIN, HELPER = ("sha", "src/main.go", "main", 1, 8, "sha256:main"), ("sha", "internal/helper.go", "helper", 3, 9, "sha256:helper")


def graph(spark, nodes, edges, revisions=(("gr", "t", "r", "s"),)):
    return (
        spark.createDataFrame(list(revisions), "revision_id string, tenant_id string, repository_id string, snapshot_id string"),
        spark.createDataFrame(nodes, f"revision_id string, node_id string, entity_type string, name string, qualified_name string, source_ref {REF}, language string"),
        spark.createDataFrame(edges, f"revision_id string, edge_id string, relation_type string, from_node_id string, to_node_id string, evidence {REF}"),
    )


@pytest.fixture(scope="module")
def sample(spark):
    nodes = [("gr", "n1", "FUNCTION", "main", "cmd.main", MAIN, "go"), ("gr", "n2", "FUNCTION", "helper", "internal.helper", HELPER, "go"), ("bare", "n1", "CLASS", "x", None, None, None)]
    revisions = [("gr", "t", "r", "s"), ("bare", "t", "r2", "s"), ("none", "t", "r3", "s")]
    return graph(spark, nodes, [("gr", "e1", "CALLS", "n1", "n2", MAIN)], revisions)


EVIDENCE = "- `internal/helper.go:3-9` (`helper`)\n- `src/main.go:1-8` (`main`)"


def test_all_pages_are_grounded_in_both_locales(sample):
    rows = {(r.locale, r.slug): r for r in P.pages(*sample, locales=["zh-CN", "en-US"]).collect()}
    assert len(rows) == 12 and {r.revision_id for r in rows.values()} == {"gr"}
    for (locale, slug), r in rows.items():
        assert r.content_md.endswith(("## 源码依据" if locale == "zh-CN" else "## Source Evidence") + "\n\n" + EVIDENCE), slug
        assert [c.path for c in r.citations] == ["internal/helper.go", "src/main.go"] and r.revision_no == 1
        overview = "page_" + hashlib.sha256(f"t\0r\0{locale}\0overview\0".encode()).hexdigest()[:24]
        assert r.parent_page_id == (None if slug == "overview" else overview) and (slug != "overview" or r.page_id == overview)
        refs = "".join(f"\0sha:{p}:{s}:{a}:{z}:{h}" for _, p, s, a, z, h in (HELPER, MAIN))
        assert r.content_hash == "sha256:" + hashlib.sha256((r.content_md + refs).encode()).hexdigest()
    text = {slug: r.content_md.split("\n\n## Source Evidence")[0] for (locale, slug), r in rows.items() if locale == "en-US"}
    assert text["overview"] == "# Project Overview\n\nThis page is generated from the current snapshot's knowledge graph; all counts are snapshot-scoped.\n\n| Entity type | Count |\n|---|---:|\n| FUNCTION | 2 |\n\nTotal entities：2；total relations：1。"
    table = "| From | Relation | To |\n|---|---|---|\n| `cmd.main` | CALLS | `internal.helper` |"
    assert text["architecture"].endswith(table) and text["key-flows"].endswith(table)
    assert text["modules"].rstrip() == "# Modules\n\n## `internal`\n\nCode entities：1\n\n- `internal.helper` (FUNCTION)\n\n## `src`\n\nCode entities：1\n\n- `cmd.main` (FUNCTION)"
    assert text["interfaces"] == "# Interfaces and Key Symbols\n\n- `cmd.main` — FUNCTION\n- `internal.helper` — FUNCTION"
    assert text["development-guide"].startswith("# Development Guide\n\n## Detected Languages\n\n- `go`\n\n## Primary Source Paths\n\n- `internal/helper.go`\n- `src/main.go`\nAfter changing code")
    assert rows["zh-CN", "overview"].title == "项目概览" and "实体总数：2；关系总数：1。" in rows["zh-CN", "overview"].content_md


def test_refusals_and_wrong_names(sample):
    assert {r.revision_id: r.reason for r in P.refused(*sample).collect()} == {"bare": "no evidence", "none": "empty"}
    for bad in ({"slugs": ["other"]}, {"locales": ["fr"]}):
        with pytest.raises(ValueError, match="unknown"):
            P.pages(*sample, **bad)


def test_long_lists_placeholders_and_numbers(spark):
    nodes = [("gr", f"n{i:02}", "CLASS", f"c{i:02}", "", ("sha", f"f{i:02}", None, 1, 1, "h"), None) for i in range(7)]
    sample = graph(spark, nodes, [])
    stored = spark.createDataFrame([(r.page_id, 4) for r in P.pages(*sample).collect()], "page_id string, revision_no long")
    rows = {r.slug: r for r in P.pages(*sample, most=3, stored=stored, locales=["en-US"]).collect()}
    assert {r.revision_no for r in rows.values()} == {1}  # the stored ones are Chinese
    assert {r.revision_no for r in P.pages(*sample, stored=stored).collect()} == {5}
    only = P.pages(*sample, ["modules"], stored=stored).first()
    assert only.parent_page_id is not None and P.pages(*sample, ["modules"]).first().parent_page_id is None
    assert "- `c02` (CLASS)\n- Remaining entities omitted.\n" in rows["modules"].content_md and "c03" not in rows["modules"].content_md
    assert "No matching relationships resolved | - | - |" in rows["key-flows"].content_md and "No interface, function" in rows["interfaces"].content_md
    assert "- No information available.\n\n## Primary" in rows["development-guide"].content_md and len(rows["modules"].citations) == 3
