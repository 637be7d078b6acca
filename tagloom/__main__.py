"""``python -m tagloom``."""

import sys

from tagloom.cli import main

sys.exit(main())
