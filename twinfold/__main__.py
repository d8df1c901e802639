import sys

from twinfold.cli import main

sys.exit(main())
