"""Queries over streaming tables.

An engine whose tables are streaming DataFrames gives streaming DataFrames for filters, projections, joins with
static tables and grouped counts that Structured Streaming can keep up to date; stream() starts such a query.
"""

from __future__ import annotations


def stream(engine, query, sink: str = "memory", name: str = "out", mode: str = "append", **options):
    """Start ``query`` as a stream into a sink; the checkpoint folder is an option of the writer."""
    writer = engine.dataframe(query).writeStream.format(sink).queryName(name).outputMode(mode)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.start()
