"""quotaflow: portfolio analytics as Spark DataFrame and Structured Streaming jobs.

Every public function is either ``Column -> Column`` (``quotaflow.functions``)
or ``DataFrame -> DataFrame`` (``quotaflow.operators``), keyed by
``portfolio_id`` so that many portfolios are processed in one job.
"""

from quotaflow.params import ScreenParams, RunParams  # noqa: F401
