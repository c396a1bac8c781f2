"""offerlake: job-offer market analytics as Spark DataFrame jobs.

Every public operator takes DataFrames (plus column-name parameters) and
returns a DataFrame; nothing is collected to the driver.
"""

from offerlake.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
