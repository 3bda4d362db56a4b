import sys

from srcintel.plans.commands import main

sys.exit(main())
