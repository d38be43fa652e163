"""clickcast: click-attribution analytics as Spark DataFrame operators.

Every operator takes and returns a ``DataFrame``; the work runs on the
executors through built-in Spark expressions (windows, aggregates, joins),
never through driver-side loops over data.
"""

from clickcast.session import checkpoint_root, local_session, scratch_path

__all__ = ["checkpoint_root", "local_session", "scratch_path"]
