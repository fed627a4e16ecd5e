"""python -m ledgerflow COMMAND"""

import sys

from ledgerflow.plans.cli import main

sys.exit(main())
