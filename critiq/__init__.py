"""critiq — review analytics as lazy Spark DataFrame operators.

Every operator takes a DataFrame (plus parameters) and returns a DataFrame.
Nothing is collected to the driver inside an operator; scalars such as a
global mean or a reference time are one-row aggregates joined back by
broadcast, so a whole analysis stays one lazy plan until a sink runs it.
"""

from critiq.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
