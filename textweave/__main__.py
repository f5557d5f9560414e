import sys

from textweave.plans.cli import main

sys.exit(main())
