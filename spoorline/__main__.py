"""python -m spoorline: experiments from the command line."""

import sys

from .plans.experiment import main

sys.exit(main())
