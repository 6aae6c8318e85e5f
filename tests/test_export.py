from pyspark.sql import functions as F

from tessera.plans import export


def test_markdown_has_all_rows_in_order(spark):
    df = spark.range(0, 250, 1, 7).select((249 - F.col("id")).alias("id")).orderBy("id")
    lines = export.markdown("Findings", {"findings": df}).splitlines()
    assert [x for x in lines if x.startswith("| ") and x != "| id |"] == [f"| {i} |" for i in range(250)]


def test_page_can_be_searched_and_opened():
    text = export.page("Findings <1>", {"findings": [{"path": "a</script>", "line": 1}, {"path": "b", "more": [1]}], "n": 3})
    assert text.count("</script>") == 2 and 'id="search"' in text and 'data-at="1"' in text and "<th>more</th>" in text and "Findings &lt;1&gt;" in text
