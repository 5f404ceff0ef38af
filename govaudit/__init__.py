"""Governance-audit analytics on Spark DataFrames.

Packets of launch documentation are scanned with policy rules written as
Catalyst columns; logs of reviewer actions are scored with window functions;
reviewers are tracked over time.  Every public function takes and returns
DataFrames (or Columns) and is lazy unless its docstring says otherwise.
"""

from govaudit.catalog import CODES

__all__ = ["CODES"]
