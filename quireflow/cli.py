"""Command line: ``python -m quireflow.cli ROOT COMMAND ...`` over an archive's tables."""

from __future__ import annotations

import argparse

from .engine import Archive
from .session import get_session


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Query an archive of documents and notes.")
    p.add_argument("root", help="folder of the archive's Parquet tables")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="notes and entries by words, with 'page N' for pages")
    s.add_argument("query")
    s.add_argument("--scope", choices=("all", "notes", "reference"), default="all")
    d = sub.add_parser("documents", help="live documents, newest first")
    d.add_argument("--view", default="general")
    for name, extra in (("structure", []), ("segment", ["entry_index"]), ("series", ["layout_id"]), ("cell", ["layout_id", "row", "column"])):
        c = sub.add_parser(name)
        c.add_argument("doc_id")
        for x in extra:
            c.add_argument(x, type=str if x == "layout_id" else int)
    sub.add_parser("orphans", help="references without a target, per table and month")
    a = p.parse_args(argv)
    archive = Archive(get_session("quireflow"), a.root)
    run = {
        "search": lambda: archive.search(a.query, a.scope), "documents": lambda: archive.documents(a.view), "structure": lambda: archive.display_items(a.doc_id),
        "segment": lambda: archive.segment(a.doc_id, a.entry_index), "series": lambda: archive.table_series(a.doc_id, a.layout_id),
        "cell": lambda: archive.table_cell(a.doc_id, a.layout_id, a.row, a.column), "orphans": lambda: archive.orphans()[1].orderBy("table_name", "period"),
    }
    run[a.command]().show(50, truncate=100)


if __name__ == "__main__":
    main()
