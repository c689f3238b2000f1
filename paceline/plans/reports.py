"""The comparison tables of a run, put together from its measurement rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paceline.operators import compare, measures
from paceline.plans.runner import CustomRun, StandardRun


def standard_report(run: StandardRun, wide: bool = True) -> dict[str, DataFrame]:
    """Leaders, comparison, chart rows, statistics and failures of a standard run.

    Tables whose name ends in ``_long`` have a row per table and connection and hold for any number of connections;
    ``wide`` adds their view with a column per connection.
    """
    report = {
        "leaders": measures.standard_leaders(run.metrics),
        "comparison": compare.comparison(run.metrics).orderBy("position"),
        "chart": compare.chart_overall(run.metrics).orderBy("position"),
        "statistics_long": compare.stats_long(run.stats).orderBy("position", "table_name", "line", "connection_name"),
        "failures": compare.failures(run.metrics),
    }
    if wide:
        connections = compare.connection_list(run.metrics)
        report["statistics"] = compare.stats_grid(run.stats, connections).orderBy("position", "table_name", "line")
    return report


def custom_report(run: CustomRun, strict: bool = True, wide: bool = True) -> dict[str, DataFrame]:
    """Leaders, grids, chart rows and failures of a custom run.

    Charts show successful connections only, grids show all of them. Tables whose name ends in ``_long`` hold for any
    number of connections; ``wide`` adds their views with a column per connection.
    """
    report = {
        "leaders": measures.custom_leaders(run.results, run.imports, measures.avg_query_time(run.timings), strict),
        "imports_long": compare.imports_long(run.results, run.imports).orderBy("position", "connection_name"),
        "loads_long": compare.loads_long(run.loads).orderBy("position", "table_name", "connection_name"),
        "queries_long": compare.queries_long(run.timings).orderBy("position", "query_name", "connection_name"),
        "import_chart": compare.chart_imports(run.results, run.imports).orderBy("position"),
        "statistics_long": compare.stats_long(run.stats).orderBy("position", "table_name", "line", "connection_name"),
        "failures": compare.failures(run.results, custom=True),
    }
    if not wide:
        return report
    connections = compare.connection_list(run.results)
    good = compare.successful(run.results)
    charted = compare.connection_list(good)
    chosen = good.select("connection_name")
    return report | {
        "imports": compare.import_grid(run.results, run.imports, connections).orderBy("position"),
        "loads": compare.load_grid(run.loads, connections).orderBy("position"),
        "queries": compare.query_grid(run.timings, connections).orderBy("position"),
        "load_chart": compare.pivot_loads(run.loads.join(chosen, "connection_name", "left_semi"), charted).orderBy("position"),
        "query_chart": compare.pivot_queries(run.timings.join(chosen, "connection_name", "left_semi"), charted).orderBy("position"),
        "statistics": compare.stats_grid(run.stats, connections).orderBy("position", "table_name", "line"),
    }
