from .kpi_stream import running_kpis  # noqa: F401
