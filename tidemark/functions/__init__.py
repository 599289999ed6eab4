from tidemark.functions.columns import *  # noqa: F401,F403
from tidemark.functions.dates import *  # noqa: F401,F403
