"""The clean_commentary query against a plain version, on whole texts."""

import re

from cuesheet.plans import texts


def first_line(text):
    t = re.sub(r"[（(][^)）]*[)）]", "", f"1. {text} (a note)\n").strip()
    lines = [re.sub(r"^\d+\. ", "", x.strip()).strip() for x in re.split(r"\r\n|[\n\r]", t)]
    return next((x for x in lines if x), "")


def test_whole_texts_are_cleaned(spark, tmp_path):
    rows = ["short", "w" * 30 + " a long first line that goes on well after forty characters", "x" * 45 + " (said\nin brackets) and on", "y" * 50 + "\nsecond line", "(gone " + "z" * 60 + ") stays"]
    spark.createDataFrame([(i, t, "en", len(t), "s") for i, t in enumerate(rows)], "doc_id long, text string, lang string, n_chars long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.line for r in texts.clean_commentary(spark, str(tmp_path)).collect()}
    assert got == {i: first_line(t) for i, t in enumerate(rows)}
