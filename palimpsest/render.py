"""Pictures of reports."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def memory_map_svg(rows: DataFrame, most: int = 20) -> str:
    """The topics with the most memories of a memory map as bars whose shade is their mean retrievability."""
    top = rows.orderBy(F.desc("n"), "topic").limit(most).collect()  # `most` rows
    longest = max((r["n"] for r in top), default=1)
    bars = [
        f'<text x="4" y="{20 * k + 14}">{escape(str(r["topic"])[:24])}</text><rect x="180" y="{20 * k + 2}" width="{300 * r["n"] / longest:.1f}" height="16" fill="hsl(210,60%,{80 - 45 * min(1.0, max(0.0, r["avg_r"] or 0.0)):.0f}%)"/><text x="490" y="{20 * k + 14}">{r["n"]}</text>'
        for k, r in enumerate(top)
    ]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="560" height="{20 * len(top) + 4}" font-size="12">{"".join(bars)}</svg>'
