from weftgraph.cli import main

main()
