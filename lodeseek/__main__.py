from lodeseek.cli import main

main()
