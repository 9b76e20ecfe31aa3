"""Workers import what these tests define."""

import os
from pathlib import Path

os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent), os.environ.get("PYTHONPATH", "")])
