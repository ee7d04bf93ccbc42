"""Ready-made stages for firewall, DNS, DHCP, proxy, portal and intrusion logs."""
