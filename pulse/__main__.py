from pulse.plans.cli import main

main()
