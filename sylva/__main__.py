from sylva.plans.search import main

main()
