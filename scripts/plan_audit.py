"""Print, per registered query, the shuffle exchanges whose input carries a wide text column.

Usage: python scripts/plan_audit.py [sf_dir] [query ...]
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitelens.plans import catalog  # noqa: E402
from sitelens.session import local_session  # noqa: E402

WIDE = re.compile(r"\b(html|css|content|html_snippet|_snip|design_doc|report_json)#")
SKIP = {"site_bfs", "extract_site", "site_report", "report_json", "design_doc", "doc_lines", "run_batch",
        "sink_report_json", "sink_report_md", "src_css_files", "stream_color_tokens"}


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or [n for n in catalog.REGISTRY if n not in SKIP]
    spark = local_session()
    qs = catalog.queries()
    for name in names:
        buf = io.StringIO()
        with redirect_stdout(buf):
            qs[name](spark, sf_dir).explain("formatted")
        text = buf.getvalue()
        blocks = re.split(r"\n\(\d+\) ", text)
        wide = [b.split("\n")[0] + " <- " + WIDE.findall(b)[0] for b in blocks
                if b.startswith(("Exchange", "BroadcastExchange")) and WIDE.search(b)]
        n_ex = sum(1 for b in blocks if b.startswith("Exchange"))
        print(f"{name:26s} exchanges={n_ex:3d} wide={wide}")
    spark.stop()


if __name__ == "__main__":
    main()
