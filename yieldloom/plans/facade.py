"""The dashboard's questions over one judged table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from yieldloom.functions.columns import displayed
from yieldloom.operators.filters import Filters
from yieldloom.plans import defects, rectification, yields
from yieldloom.sources import tables


Source = Callable[[], DataFrame]
_default: list[Source] = []


def set_default_source(source: Source | None) -> None:
    """What DashboardQueries reads where it is given nothing: a function that returns the judged table. None: nothing again."""
    _default[:] = [source] if source else []


def folder_source(spark: SparkSession, folder: str, mapper: Mapper | None = None) -> Source:
    """The judged batches of a folder, and of those that come later; mapper: their columns under this package's names."""
    return lambda: mapped(tables.judged_of(spark, folder), mapper or {})


Mapper = Mapping[str, str]


def mapped(df: DataFrame, mapper: Mapper) -> DataFrame:
    """Columns of another naming by this package's names; others stay."""
    return df.withColumnsRenamed({old: new for new, old in mapper.items()})


def query_tables(spark: SparkSession, sql: str, **paths: str) -> DataFrame:
    """Spark SQL over Parquet tables by the names given; a path within a folder of batches is what its manifest says."""
    return spark.sql(sql, **{name: tables.read_table(spark, path) for name, path in paths.items()})


class DashboardQueries:
    """tie: the columns that decide between equal times of a unit. judged: the table, a function that returns it at each question,
    or nothing for the default source."""

    def __init__(self, judged: DataFrame | Source | None = None, tie: list | None = None):
        if judged is None and not _default:
            raise ValueError("no judged table and no default source")
        self.source, self.tie = judged if judged is not None else _default[0], tie or []

    @property
    def judged(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()

    def get_summary(self, line: str | None = None) -> DataFrame:
        return yields.summary(self.judged, Filters(line=line))

    def get_daily_yield(self, line: str | None = None, days: int = 14, cutoff: int = 7) -> DataFrame:
        return yields.last_days(yields.daily(self.judged, Filters(line=line, cutoff=cutoff)), days)

    def get_vendor_yield(self) -> DataFrame:
        return yields.by_group(self.judged, "Vendor")

    def get_line_yield(self) -> DataFrame:
        return yields.by_group(self.judged, "Line")

    def get_projects(self) -> DataFrame:
        return yields.projects(self.judged)

    def get_lines_for_project(self, project: str) -> DataFrame:
        return yields.lines_of(self.judged, project)

    def get_daily_yield_by_project_line(self, project: str | None = None, line: str | None = None, regression: bool = True, cutoff: int = 7) -> DataFrame:
        return yields.daily_by_project_line(self.judged, self.tie, regression, Filters(project, line, cutoff=cutoff))

    def get_regression_summary(self) -> DataFrame:
        return yields.regression_summary(self.judged)

    def get_regression_daily(self, line: str | None = None) -> DataFrame:
        return yields.regression_daily(self.judged, self.tie, Filters(line=line))

    def get_rectification_stats(self, project: str | None = None, line: str | None = None) -> DataFrame:
        return rectification.stats(self.judged, self.tie, Filters(project, line))

    def get_regression_unique_sn(self, line: str | None = None, start: str | None = None, end: str | None = None, columns: str = "core", vendor: str | None = None) -> DataFrame:
        """Each unit's last row at its first time. columns: core, minimal (no verdicts), all; rows are filtered before they are collapsed."""
        return yields.regression_rows(self.judged, self.tie, columns, Filters(line=line, vendor=vendor, start=start, end=end))

    def get_regression_unique_sn_fast(self, line: str | None = None, start: str | None = None, end: str | None = None, full_columns: bool = False, vendor: str | None = None) -> DataFrame:
        return self.get_regression_unique_sn(line, start, end, "all" if full_columns else "core", vendor)

    def get_regression_unique_sn_rawdata(self, line: str | None = None, start: str | None = None, end: str | None = None, columns: str = "minimal", vendor: str | None = None) -> DataFrame:
        return self.get_regression_unique_sn(line, start, end, columns, vendor)

    def get_top_defects(self, n: int = 20, start: str | None = None, end: str | None = None) -> DataFrame:
        return defects.top(self.judged, n, Filters(start=start, end=end))

    def get_fai_defect_detail(self, name: str, n: int = 100, start: str | None = None, end: str | None = None) -> DataFrame:
        return defects.detail(self.judged, name, self.tie, n, Filters(start=start, end=end))

    def report(self, days: int = 10, top: int = 10) -> dict[str, DataFrame]:
        """What a printed report has: totals, lines, last days, units and the worst dimensions, each a few rows."""
        return {
            "summary": self.get_summary(), "lines": self.get_line_yield(), "days": displayed(self.get_daily_yield(days=days)),
            "units": self.get_regression_summary(), "top": displayed(self.get_top_defects(top)),
        }
