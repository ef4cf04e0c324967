"""tablesteps: composable, Spark-planned data-preparation steps.

Every step is a ``DataFrame -> DataFrame`` function (use it with
``df.transform``); sources return DataFrames and sinks consume them.
Nothing here moves a whole table through the driver.
"""

from tablesteps.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
