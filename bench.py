"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans import QUERIES  # noqa: E402
from quire.session import local_session  # noqa: E402

HEADLINE = [
    "paginate_pages", "search_pages", "search_phrases", "hit_rects", "layout_blocks", "layout_spaced_text", "table_cells",
    "compare_documents", "find_for_redaction", "redacted_items", "objects_under_marks", "numbered_pages", "page_labels",
    "move_pages", "calculated_fields", "accessibility_audit", "hidden_information_report", "picture_decisions",
    "ocr_pages", "outline_rows", "visible_counts", "recent_files", "file_changes", "page_edits",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # One small run starts the workers and warms the JVM; it is not counted.
    QUERIES["search_pages"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
