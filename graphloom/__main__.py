from graphloom.service.cli import main

raise SystemExit(main())
