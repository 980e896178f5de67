from lexiloom.cli import main

raise SystemExit(main())
