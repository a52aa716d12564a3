"""quarry — source-corpus curation as Spark DataFrame operators.

Layers:
  functions/  column expressions (code-line fold, licence rule, lint signals, text helpers)
  operators/  DataFrame -> DataFrame operators (verdict, catalogue, tags, search, stats, jobs)
  sources/    readers and writers (landing JSON, catalogue tables, exports, snapshots)
  plans/      composed jobs and the bindings of the driver's tables
  streaming/  incremental ingest and job-state streams
"""

from quarry.schema import Thresholds

__all__ = ["Thresholds"]
