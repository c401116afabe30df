"""These tests are a package, so that their modules may be named like others; helpers lie beside them."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
