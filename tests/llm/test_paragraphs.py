"""Paragraphs that go on over a page break."""

from quarryline.llm.scans import document_paragraphs

SCHEMA = "block_id long, pdf_file string, block_idx int, block_type string, text string, text_level int, page_idx int"


def test_words_are_joined_over_pages(spark):
    rows = [(100 + p, "a.pdf", p * 10, "text", f"Running Header 202{p}", None, p) for p in range(4)] + [(110 + p, "a.pdf", p * 10 + 9, "text", f"Page {p + 1} of 4", None, p) for p in range(4)]
    rows += [
        (1, "a.pdf", 1, "text", "One.", None, 0), (2, "a.pdf", 2, "text", "The ben-", None, 0), (3, "a.pdf", 11, "text", "chmark figure was", None, 1), (4, "a.pdf", 21, "text", "restated.", None, 2), (5, "a.pdf", 22, "text", "Next.", None, 2),
        (6, "a.pdf", 23, "text", "Not ended", None, 2), (7, "a.pdf", 31, "text", "Heading", 1, 3), (8, "a.pdf", 32, "text", "Last", None, 3), (9, "b.pdf", 1, "text", "other", None, 4),
    ]
    got = sorted(map(tuple, document_paragraphs(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame([], "name string")).collect()))
    assert got == [
        ("a.pdf", 0, 0, 0, "One."), ("a.pdf", 1, 0, 2, "The benchmark figure was restated."), ("a.pdf", 2, 2, 2, "Next."), ("a.pdf", 3, 2, 2, "Not ended"), ("a.pdf", 4, 3, 3, "Heading"), ("a.pdf", 5, 3, 3, "Last"), ("b.pdf", 0, 4, 4, "other"),
    ]
