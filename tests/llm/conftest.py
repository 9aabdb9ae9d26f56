import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures_llm import use_path  # noqa: E402

use_path()
