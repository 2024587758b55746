"""Re-export of the checker's value digest for the tests."""
import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                "scripts"))
from oracle_check import digest  # noqa: E402,F401
