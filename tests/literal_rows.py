"""What the queries of literal_queries.py return: columns with their types, and rows, read through by hand."""

# fmt: off
ROWS: dict[str, tuple[list[str], list[tuple]]] = {
    "huawei_interface_rows": (
        ["block INTEGER", "row_no INTEGER", "name VARCHAR", "status VARCHAR", "protocol VARCHAR"],
        [
            (0, 0, 'Eth-Trunk1', 'up', 'up'),
            (0, 1, 'GigabitEthernet0/0/1', 'admin-down', 'down'),
            (0, 2, 'LoopBack0', 'up', 'up'),
        ],
    ),
    "huawei_route_rows": (
        ["block INTEGER", "row_no INTEGER", "vrf VARCHAR", "prefix VARCHAR", "mask_len BIGINT", "protocol VARCHAR", "preference BIGINT", "metric BIGINT", "next_hop VARCHAR", "outgoing_interface VARCHAR"],
        [
            (0, 0, 'default', '10.0.0.0', 8, 'static', 60, 0, '10.1.1.1', 'GigabitEthernet0/0/1'),
            (0, 1, 'default', '10.2.0.0', 16, 'ospf', 10, 3, '10.1.1.2', 'Eth-Trunk1'),
            (0, 2, 'VPN-A', '172.16.0.0', 12, 'ibgp', 255, 0, '1.1.1.1', 'Tunnel0'),
        ],
    ),
    "huawei_label_rows": (
        ["block INTEGER", "row_no INTEGER", "fec VARCHAR", "in_label BIGINT", "out_label VARCHAR", "action VARCHAR", "outgoing_interface VARCHAR"],
        [
            (0, 0, '1.1.1.1/32', 0, '3', 'pop', 'GE0/0/1'),
            (0, 1, '2.2.2.2/32', 1024, '3', 'pop', 'GE0/0/1'),
            (0, 2, '3.3.3.3/32', 1025, '2048', 'swap', 'GE0/0/2'),
            (0, 3, '4.4.4.4/32', 0, '1030', 'push', 'GE0/0/3'),
        ],
    ),
    "huawei_neighbor_rows": (
        ["block INTEGER", "row_no INTEGER", "protocol VARCHAR", "area_id VARCHAR", "local_interface VARCHAR", "remote_id VARCHAR", "state VARCHAR"],
        [
            (0, 0, 'ldp', None, None, '2.2.2.2', 'operational'),
            (0, 0, 'ospf', '0.0.0.0', 'GE0/0/1', '2.2.2.2', 'full'),
            (0, 1, 'ospf', '0.0.0.1', 'GE0/0/2', '3.3.3.3', '2-way'),
        ],
    ),
    "cisco_interface_rows": (
        ["block INTEGER", "row_no INTEGER", "name VARCHAR", "ip_address VARCHAR", "status VARCHAR", "protocol VARCHAR"],
        [
            (0, 0, 'Gi0/0', '10.0.0.1', 'up', 'up'),
            (0, 1, 'Gi0/1', '', 'admin-down', 'down'),
        ],
    ),
    "cisco_route_rows": (
        ["block INTEGER", "row_no INTEGER", "prefix VARCHAR", "mask_len BIGINT", "protocol VARCHAR", "preference BIGINT", "metric BIGINT", "next_hop VARCHAR", "outgoing_interface VARCHAR"],
        [
            (0, 0, '0.0.0.0', 0, 'static', 1, 0, '10.0.0.254', ''),
            (0, 1, '10.0.0.0', 24, 'connected', 0, 0, '', 'Gi0/0'),
            (0, 2, '10.9.0.0', 16, 'ospf', 110, 20, '10.0.0.2', 'Gi0/1'),
        ],
    ),
    "cisco_label_rows": (
        ["block INTEGER", "row_no INTEGER", "fec VARCHAR", "in_label BIGINT", "out_label VARCHAR", "action VARCHAR", "outgoing_interface VARCHAR", "next_hop VARCHAR"],
        [
            (0, 0, '10.0.0.2/32', 16, '', 'pop', 'Gi0/1', '10.1.1.2'),
            (0, 1, '10.0.0.3/32', 17, '24001', 'swap', 'Gi0/2', '10.1.2.2'),
            (0, 2, '10.0.0.4/32', 18, '', 'pop', 'Gi0/3', '10.1.3.2'),
        ],
    ),
    "cisco_neighbor_rows": (
        ["block INTEGER", "row_no INTEGER", "protocol VARCHAR", "remote_id VARCHAR", "state VARCHAR", "remote_address VARCHAR", "local_interface VARCHAR"],
        [
            (0, 0, 'ospf', '2.2.2.2', 'full', '10.0.0.2', 'Gi0/0'),
            (0, 1, 'ospf', '3.3.3.3', '2way', '10.0.0.3', 'Gi0/0'),
        ],
    ),
    "juniper_rows": (
        ["kind VARCHAR", "row_no INTEGER", "name VARCHAR", "status VARCHAR", "ip_address VARCHAR", "mask VARCHAR"],
        [
            ('interface', 0, 'ge-0/0/0', 'up', '', ''),
            ('interface', 1, 'ge-0/0/0.0', 'up', '10.0.0.1', '30'),
            ('interface', 2, 'ge-0/0/1', 'admin-down', '', ''),
            ('neighbor', 0, '2.2.2.2', 'full', '10.0.0.2', 'ge-0/0/0.0'),
        ],
    ),
    "juniper_route_rows": (
        ["block INTEGER", "row_no INTEGER", "vrf VARCHAR", "prefix VARCHAR", "mask_len BIGINT", "protocol VARCHAR", "preference BIGINT", "metric BIGINT", "next_hop VARCHAR", "outgoing_interface VARCHAR"],
        [
            (0, 0, 'default', '10.0.0.0', 24, 'direct', 0, 0, '', ''),
            (0, 1, 'default', '10.5.0.0', 16, 'ospf', 10, 2, '10.0.0.2', 'ge-0/0/0.0'),
        ],
    ),
    "h3c_interface_rows": (
        ["block INTEGER", "row_no INTEGER", "name VARCHAR", "type VARCHAR", "status VARCHAR", "ip_address VARCHAR", "description VARCHAR"],
        [
            (0, 0, 'FGE2/0/1', 'physical', 'up', '10.48.58.244', 'to core one'),
            (0, 1, 'GE1/0/2', 'physical', 'admin-down', '', ''),
            (0, 2, 'Loop0', 'physical', 'up', '1.1.1.1', '--'),
            (1, 0, 'FGE2/0/1', 'physical', 'up', '', '1'),
            (1, 1, 'GE1/0/3', 'physical', 'admin-down', '', '1 spare port'),
            (2, 0, 'GigabitEthernet1/0/1', 'physical', 'up', '10.0.0.1', 'to edge 7'),
            (2, 1, 'LoopBack0', 'loopback', 'up(spoofing)', '2.2.2.2', ''),
            (2, 2, 'Tunnel1', 'tunnel', 'administratively', '', ''),
        ],
    ),
    "h3c_neighbor_rows": (
        ["block INTEGER", "row_no INTEGER", "protocol VARCHAR", "remote_id VARCHAR", "area_id VARCHAR", "local_interface VARCHAR", "state VARCHAR"],
        [
            (0, 0, 'bgp', '10.48.58.245', '1001', '', 'established'),
            (0, 1, 'bgp', '10.48.58.246', '1002', '', 'idle'),
            (1, 0, 'ospf', '10.0.0.2', '0.0.0.0', 'GE0/0', 'full'),
        ],
    ),
    "h3c_route_rows": (
        ["block INTEGER", "row_no INTEGER", "vrf VARCHAR", "prefix VARCHAR", "mask_len BIGINT", "protocol VARCHAR", "preference BIGINT", "metric BIGINT", "next_hop VARCHAR", "outgoing_interface VARCHAR"],
        [
            (0, 0, 'default', '10.0.0.0', 8, 'ospf', 10, 3, '10.1.1.1', 'FGE2/0/1'),
            (0, 1, 'default', '10.2.0.0', 16, 'static', 60, 0, '10.1.1.2', 'GE1/0/1'),
            (0, 2, 'default', '10.3.0.0', 16, 'direct', 0, 0, '10.3.0.1', 'Vlan3'),
            (0, 3, 'default', '10.4.0.0', 16, 'bgp', 255, 0, '9.9.9.9', 'GE1/0/2'),
        ],
    ),
    "dsl_access_lists": (
        ["k INTEGER", "row_no INTEGER", "acl VARCHAR", "rule VARCHAR", "action VARCHAR"],
        [
            (1, 0, '3000', '5', 'permit'),
            (1, 1, '3000', '10', 'deny'),
            (1, 2, '2001', '0', 'permit'),
        ],
    ),
    "dsl_route_policies": (
        ["k INTEGER", "row_no INTEGER", "policy VARCHAR", "action VARCHAR", "node VARCHAR", "what VARCHAR", "clause VARCHAR"],
        [
            (1, 0, 'OUT', 'permit', '10', 'if-match', 'ip-prefix P1'),
            (1, 1, 'OUT', 'permit', '10', 'apply', 'cost 20'),
            (1, 2, 'IN', 'permit', '5', 'if-match', 'tag 7'),
        ],
    ),
    "dsl_skips": (
        ["k INTEGER", "row_no INTEGER", "name VARCHAR", "value VARCHAR"],
        [
            (1, 0, 'a', '1'),
            (1, 1, 'b', '2'),
        ],
    ),
    "log_blocks": (
        ["file VARCHAR", "block_no INTEGER", "hostname VARCHAR", "vendor VARCHAR", "command VARCHAR", "command_norm VARCHAR", "cmd_type VARCHAR", "category VARCHAR", "captured_at VARCHAR"],
        [
            ('a.log', 0, 'core-S12700', 'huawei', 'display version', 'display version', 'unknown', 'other', '2026-03-21 13:11:26'),
            ('a.log', 1, 'core-S12700', 'huawei', 'display current-configuration', 'display current-configuration', 'config', 'config', None),
            ('a.log', 2, 'core-S12700', 'huawei', 'display ospf peer', 'display ospf peer', 'neighbor', 'ospf', None),
            ('a.log', 4, 'edge-ASR9912', 'cisco', 'show mpls forwarding', 'show mpls forwarding', 'lfib', 'mpls', None),
            ('a.log', 5, 'edge-ASR9912', 'cisco', 'show clock detail', 'show clock detail', 'unknown', 'other', None),
            ('a.log', 6, 'agg-H9850C', 'h3c', 'dis cur', 'display current-configuration', 'config', 'config', None),
        ],
    ),
    "log_devices": (
        ["device_id VARCHAR", "hostname VARCHAR", "vendor VARCHAR", "commands VARCHAR", "os_version VARCHAR", "model VARCHAR"],
        [
            ('agg-h9850c', 'agg-H9850C', 'h3c', 'dis cur', 'Comware 7.1.070', 'H9850C'),
            ('core-s12700', 'core-S12700', 'huawei', 'display version; display current-configuration; display ospf peer; display ip rout ?', 'VRP V800R021', 'S12700'),
            ('edge-asr9912', 'edge-ASR9912', 'cisco', 'show mpls forwarding; show clock detail', '', 'ASR9912'),
            ('lone-ce6800', 'lone-CE6800', 'huawei', '', 'VRP V200R005', 'CE6800'),
        ],
    ),
    "log_facts": (
        ["what VARCHAR", "device_id VARCHAR", "said VARCHAR"],
        [
            ('config', 'agg-h9850c', 'version 7.1.070|#'),
            ('config', 'core-s12700', '!Software Version V800R021|sysname core-S12700|#'),
            ('config', 'lone-ce6800', '#|sysname lone-CE6800|!Software Version V200R005|interface LoopBack0| ip address 9.9.9.9 32|#'),
            ('label', 'edge-asr9912', '16 pop 10.0.0.2/32'),
            ('neighbor', 'core-s12700', 'ospf 2.2.2.2 full'),
            ('pad', 'core-s12700', 'raw display version'),
            ('pad', 'edge-asr9912', 'label show mpls forwarding'),
            ('pad', 'edge-asr9912', 'raw show clock detail'),
        ],
    ),
    "device_models": (
        ["hostname VARCHAR", "model VARCHAR"],
        [
            ('S6800-a', 'S6800'),
            ('asr9912.lab', 'ASR9912'),
            ('bj-NE40E-X8', 'NE40E'),
            ('ce-n9k-c9300', 'C9300'),
            ('plain', ''),
            ('sh-H12516AF-1', 'H12516AF'),
            ('vmx-2', 'VMX'),
            ('x_HW12816', 'HW12816'),
        ],
    ),
    "os_versions": (
        ["i INTEGER", "os_version VARCHAR"],
        [
            (1, 'VRP V800R011C00'),
            (2, 'IOS-XR 7.3.2'),
            (3, 'IOS-XR 6.5.1'),
            (4, 'Comware 7.1.070'),
            (5, 'JUNOS 20.4R3'),
            (6, ''),
        ],
    ),
    "clean_configs": (
        ["i INTEGER", "text VARCHAR"],
        [
            (1, '!! IOS|hostname a|end'),
            (2, '#|sysname b|#'),
            (3, ''),
            (4, 'kept <x>y'),
        ],
    ),
    "longest_outputs": (
        ["vendor VARCHAR", "command_norm VARCHAR", "command VARCHAR", "output VARCHAR", "first_seen_at INTEGER", "blocks BIGINT"],
        [
            ('cisco', 'show y', 'show y', '', 4, 1),
            ('huawei', 'display x {id}', 'display x 2', 'abcd', 1, 3),
        ],
    ),
    "question_kinds": (
        ["question_id INTEGER", "intent VARCHAR", "protocol VARCHAR", "term VARCHAR"],
        [
            (1, 'InterfaceStatus', '', 'show'),
            (2, 'Complex', 'bgp', 'why'),
            (3, 'ConfigSearch', '', 'vlan'),
            (4, 'DeviceList', '', '列出'),
            (5, 'NeighborList', 'ospf', 'display'),
            (6, 'Complex', 'mpls', 'hello'),
            (7, 'NeighborList', 'tunnel', 'list'),
        ],
    ),
    "question_devices": (
        ["question_id INTEGER", "device_id VARCHAR"],
        [
            (1, 'd1'),
            (2, 'edge2'),
        ],
    ),
    "question_sections": (
        ["i INTEGER", "config VARCHAR"],
        [
            (1, '#|bgp 100| peer 10.0.0.1 as-number 200|#'),
            (2, ''),
            (3, '#|ospf 1| area 0|#|#|ip route-static 0.0.0.0 0 10.0.0.9|#'),
        ],
    ),
    "question_context": (
        ["question_id INTEGER", "device_id VARCHAR", "intent VARCHAR", "protocol VARCHAR", "term VARCHAR", "config VARCHAR"],
        [
            (1, 'd1', 'InterfaceStatus', '', 'show', ''),
            (2, 'edge2', 'Complex', 'bgp', 'why', '#|bgp 65001| peer 1.1.1.1 enable|#'),
            (3, None, 'ConfigSearch', '', 'vlan', ''),
        ],
    ),
    "names_and_sizes": (
        ["i INTEGER", "size VARCHAR", "identifier VARCHAR", "cmd_type VARCHAR", "column_name VARCHAR", "group_names VARCHAR", "minute VARCHAR"],
        [
            (1, '1023B', 'TrafficPolicyStatistics', 'generated:huawei:traffic_policy_statistics', 'ip_address', 'a,b', '2026-03-05 07:08'),
            (2, '1.5KB', 'Version', 'generated:huawei:version', 'phy_status', '', '2026-03-05 07:08'),
            (3, '5.0MB', 'IpRoutingTableVpnInstanceVerbose', 'generated:huawei:ip_routing_table_vpn_instance_verbose', 'größe_mb', 'only', '2026-03-05 07:08'),
        ],
    ),
    "knowledge_groups": (
        ["source_group VARCHAR", "hits BIGINT", "score DOUBLE"],
        [
            (':x', 1, 0.5),
            ('local', 1, 0.5),
            ('wiki', 2, 0.5),
        ],
    ),
    "config_interfaces": (
        ["vendor VARCHAR", "name VARCHAR", "type VARCHAR", "ip_address VARCHAR", "mask VARCHAR", "description VARCHAR", "status VARCHAR"],
        [
            ('cisco', 'GigabitEthernet0/0/0/1', 'physical', '10.0.0.2', '255.255.255.252', 'to b', 'up'),
            ('cisco', 'Loopback0', 'loopback', '2.2.2.2', '255.255.255.255', '', 'down'),
            ('huawei', 'Eth-Trunk3.12', 'subinterface', '', '', '', 'down'),
            ('huawei', 'GigabitEthernet0/0/1', 'physical', '10.0.0.1', '255.255.255.252', 'to b', 'up'),
            ('huawei', 'LoopBack0', 'loopback', '1.1.1.1', '32', '', 'up'),
            ('juniper', 'ge-0/0/0', 'physical', '', '', 'uplink #3 to core; {main}', 'up'),
            ('juniper', 'ge-0/0/0.0', 'subinterface', '10.0.0.1', '30', '', 'up'),
            ('juniper', 'ge-0/0/0.5', 'subinterface', '10.0.5.1', '24', '', 'down'),
            ('juniper', 'ge-0/0/1', 'physical', '', '', '', 'down'),
            ('juniper', 'ge-0/0/1.0', 'subinterface', '10.0.1.1', '30', '', 'down'),
        ],
    ),
    "config_routes_and_members": (
        ["what VARCHAR", "said VARCHAR"],
        [
            ('igp', 'isis 7 LoopBack0'),
            ('igp', 'ospf 1 GigabitEthernet0/0/1'),
            ('route', ' 0.0.0.0 0.0.0.0 10.0.0.2'),
            ('route', 'RED 10.9.0.0 255.255.0.0 10.0.0.2'),
        ],
    ),
    "config_expected_commands": (
        ["vendor VARCHAR", "command VARCHAR", "category VARCHAR", "priority INTEGER", "cmd_type VARCHAR", "covered BOOLEAN"],
        [
            ('huawei', 'display bgp peer', 'bgp', 2, 'neighbor', True),
            ('huawei', 'display interface brief', 'interface', 1, 'interface', True),
            ('huawei', 'display ip routing-table vpn-instance RED', 'routing', 3, 'rib', True),
            ('huawei', 'display ip routing-table', 'routing', 2, 'rib', True),
            ('huawei', 'display ospf peer', 'ospf', 2, 'neighbor', True),
            ('huawei', 'display version', 'system', 1, 'unknown', False),
        ],
    ),
    "config_coverage": (
        ["vendor VARCHAR", "total BIGINT", "covered BIGINT", "percent DOUBLE"],
        [
            ('huawei', 6, 5, 83.3333),
        ],
    ),
    "config_peers": (
        ["vendor VARCHAR", "local_as BIGINT", "address_family VARCHAR", "peer_ip VARCHAR", "remote_as BIGINT", "peer_group VARCHAR", "update_source VARCHAR", "import_policy VARCHAR", "export_policy VARCHAR"],
        [
            ('cisco', 100, 'ipv4 unicast', '10.0.0.9', 900, '', '', 'P1', ''),
            ('cisco', 100, 'vpnv4 unicast', '1.1.1.1', 100, 'IN', 'Loopback0', '', ''),
            ('huawei', 100, 'ipv4-unicast', '2.2.2.2', 100, 'IN', 'LoopBack0', '', ''),
            ('huawei', 100, 'ipv4-unicast', '3.3.3.3', 300, '', '', 'P1', ''),
            ('huawei', 100, 'ipv4-unicast', '3.3.3.3', 300, '', '', 'P1', ''),
            ('juniper', 65000, 'ipv4-unicast', '2.2.2.2', 65000, 'IN', '1.1.1.1', '', 'OUT'),
            ('juniper', 65000, 'vpnv4', '2.2.2.2', 65000, 'IN', '1.1.1.1', '', 'OUT'),
        ],
    ),
    "config_vrfs": (
        ["vendor VARCHAR", "vrf_name VARCHAR", "rd VARCHAR", "import_rt VARCHAR", "export_rt VARCHAR", "import_policy VARCHAR"],
        [
            ('cisco', 'BLUE', '100:2', '', '', ''),
            ('cisco', 'RED', '100:5', '100:1 100:2', '100:1', 'P1'),
            ('huawei', 'RED', '100:1', '100:1', '100:1 100:2', ''),
            ('juniper', 'RED', '1:1', '', '', 'IMP'),
        ],
    ),
    "config_policies": (
        ["vendor VARCHAR", "policy VARCHAR", "sequence INTEGER", "action VARCHAR", "match VARCHAR", "apply VARCHAR"],
        [
            ('cisco', 'ALL', 0, 'permit', '', ''),
            ('cisco', 'P1', 10, 'permit', 'community=(C1, C2); next-hop=N1', 'local-preference=200'),
            ('cisco', 'P1', 20, 'deny', 'destination-prefix-set=D1', ''),
            ('cisco', 'P1', 30, '', '', 'prepend=as-path 100 2'),
            ('huawei', 'P1', 10, 'permit', 'ip-prefix=X', 'cost=20; local-preference=200'),
            ('huawei', 'P1', 20, 'deny', '', ''),
            ('juniper', 'OUT', 10, 'accept', 'protocol direct', ''),
            ('juniper', 'OUT', 20, 'reject', '', ''),
        ],
    ),
    "topology_links": (
        ["device_id VARCHAR", "name VARCHAR", "peer VARCHAR", "peer_interface VARCHAR", "sources VARCHAR"],
        [
            ('a', 'Eth-Trunk1', 'c', 'GE9', 'description,subnet'),
            ('a', 'GE1', 'b', 'Gi0/1', 'description,subnet'),
            ('b', 'Gi0/1', 'a', 'GE1', 'description,subnet'),
            ('c', 'GE9', 'a', 'Eth-Trunk1', 'subnet'),
        ],
    ),
    "topology_aggregates": (
        ["what VARCHAR", "device_id VARCHAR", "name VARCHAR", "other VARCHAR"],
        [
            ('lag', 'a', 'Eth-Trunk1', 'GE2'),
            ('lag', 'c', 'Eth-Trunk7', ''),
            ('parent', 'a', 'GE2', 'Eth-Trunk1'),
        ],
    ),
    "topology_peer_groups": (
        ["device_id VARCHAR", "peer_group VARCHAR", "kind VARCHAR", "role VARCHAR", "peers BIGINT"],
        [
            ('a', '10.0.0.2', 'external', 'external', 1),
            ('a', 'RR-CLIENTS', 'internal', 'reflector', 2),
            ('b', 'TRANSIT', 'external', 'upstream', 1),
        ],
    ),
    "topology_peer_interfaces": (
        ["device_id VARCHAR", "peer_ip VARCHAR", "name VARCHAR"],
        [
            ('a', '10.0.0.2', 'GE1'),
            ('a', '10.0.1.8', 'Eth-Trunk1'),
            ('a', '10.0.1.9', 'Eth-Trunk1'),
            ('b', '10.0.0.1', 'Gi0/1'),
        ],
    ),
    "topology_precheck": (
        ["device_id VARCHAR", "ospf BIGINT", "ospf_full BIGINT", "bgp BIGINT", "bgp_up BIGINT", "interfaces BIGINT", "interfaces_up BIGINT", "missing BIGINT", "safe BOOLEAN"],
        [
            ('a', 1, 1, 1, 1, 3, 2, 2, False),
            ('b', 1, 0, 0, 0, 1, 1, 1, False),
            ('c', 0, 0, 1, 0, 2, 1, 0, False),
        ],
    ),
    "topology_summary": (
        ["device_id VARCHAR", "hostname VARCHAR", "interfaces BIGINT", "peers BIGINT", "linked BIGINT"],
        [
            ('a', 'core1', 3, 3, 2),
            ('b', 'edge2', 1, 1, 1),
            ('c', 'agg3', 2, 0, 1),
        ],
    ),
    "plan_isolation": (
        ["device_id VARCHAR", "phase INTEGER", "step INTEGER", "command VARCHAR"],
        [
            ('a', 1, 1, 'save configuration'),
            ('a', 2, 1, 'raise cost of ospf 1'),
            ('a', 3, 1, 'wait for convergence'),
            ('a', 4, 1, 'disable ldp on GE1'),
            ('a', 5, 1, 'shut peer group ISP'),
            ('a', 5, 2, 'shut peer group RR-CLIENTS'),
            ('a', 6, 1, 'shut interface GE1'),
            ('b', 1, 1, 'save configuration'),
            ('b', 3, 1, 'wait for convergence'),
        ],
    ),
    "plan_upgrade": (
        ["device_id VARCHAR", "phase INTEGER", "step INTEGER", "command VARCHAR"],
        [
            ('a', 0, 1, 'display version'),
            ('a', 1, 1, 'confirm that the target version is V8R22'),
            ('a', 1, 2, 'confirm that flash: has room'),
            ('a', 1, 3, 'confirm that new.cc is on the device'),
            ('a', 2, 1, 'raise cost of ospf 1'),
            ('a', 2, 2, 'wait for convergence'),
            ('a', 2, 3, 'disable ldp on GE1'),
            ('a', 2, 4, 'shut peer group ISP'),
            ('a', 2, 5, 'shut peer group RR-CLIENTS'),
            ('a', 3, 1, 'shut interface GE1'),
            ('a', 4, 1, 'start new.cc and reload'),
            ('a', 5, 1, 'confirm that display version says V8R22'),
            ('a', 5, 2, 'confirm that no hardware alarm is there'),
            ('a', 6, 1, 'undo shut interface GE1'),
            ('a', 6, 2, 'undo shut peer group RR-CLIENTS'),
            ('a', 6, 3, 'undo shut peer group ISP'),
            ('a', 6, 4, 'enable ldp on GE1'),
            ('a', 6, 5, 'wait for convergence'),
            ('a', 6, 6, 'restore cost of ospf 1'),
            ('a', 7, 1, 'display version'),
        ],
    ),
    "plan_cutover": (
        ["device_id VARCHAR", "old VARCHAR", "new VARCHAR", "phase INTEGER", "step INTEGER", "command VARCHAR"],
        [
            ('a', 'ge1', 'GE8', 0, 0, 'display interface ge1'),
            ('a', 'ge1', 'GE8', 1, 1, 'confirm that ge1 leads to b'),
            ('a', 'ge1', 'GE8', 2, 2, 'interface GE8'),
            ('a', 'ge1', 'GE8', 2, 3, 'description to-EDGE2-uplink'),
            ('a', 'ge1', 'GE8', 2, 4, 'ip address 10.0.0.1 30'),
            ('a', 'ge1', 'GE8', 3, 5, 'display interface GE8'),
            ('a', 'ge1', 'GE8', 4, 6, 'move traffic from ge1 to GE8'),
            ('a', 'ge1', 'GE8', 5, 7, 'shut interface ge1'),
            ('a', 'ge1', 'GE8', 6, 8, 'display interface GE8'),
            ('b', 'GI0/1', 'Gi0/9', 0, 0, 'display interface GI0/1'),
            ('b', 'GI0/1', 'Gi0/9', 1, 1, 'confirm that GI0/1 leads to a'),
            ('b', 'GI0/1', 'Gi0/9', 2, 2, 'interface Gi0/9'),
            ('b', 'GI0/1', 'Gi0/9', 2, 3, 'description link core1'),
            ('b', 'GI0/1', 'Gi0/9', 2, 4, 'ipv4 address 10.0.0.2 255.255.255.252'),
            ('b', 'GI0/1', 'Gi0/9', 3, 5, 'display interface Gi0/9'),
            ('b', 'GI0/1', 'Gi0/9', 4, 6, 'move traffic from GI0/1 to Gi0/9'),
            ('b', 'GI0/1', 'Gi0/9', 5, 7, 'shut interface GI0/1'),
            ('b', 'GI0/1', 'Gi0/9', 6, 8, 'display interface Gi0/9'),
            ('c', 'nope', 'GE5', 0, 0, 'display interface nope'),
            ('c', 'nope', 'GE5', 1, 1, 'confirm that nope leads to no known device'),
            ('c', 'nope', 'GE5', 2, 2, 'interface GE5'),
            ('c', 'nope', 'GE5', 3, 5, 'display interface GE5'),
            ('c', 'nope', 'GE5', 4, 6, 'move traffic from nope to GE5'),
            ('c', 'nope', 'GE5', 5, 7, 'shut interface nope'),
            ('c', 'nope', 'GE5', 6, 8, 'display interface GE5'),
        ],
    ),
    "graph_of_facts": (
        ["src VARCHAR", "dst VARCHAR", "type VARCHAR"],
        [
            ('a', 'a1', 'HAS_INTERFACE'),
            ('a', 'a2', 'HAS_INTERFACE'),
            ('a', 'a3', 'HAS_INTERFACE'),
            ('a', 'b', 'PEER'),
            ('a1', '10.0.0.0/30', 'IN_SUBNET'),
            ('a1', 'b1', 'CONNECTS_TO'),
            ('a2', 'a3', 'MEMBER_OF'),
            ('a3', '10.0.1.0/24', 'IN_SUBNET'),
            ('a3', 'c1', 'CONNECTS_TO'),
            ('b', 'a', 'PEER'),
            ('b', 'b1', 'HAS_INTERFACE'),
            ('b1', '10.0.0.0/30', 'IN_SUBNET'),
            ('b1', 'a1', 'CONNECTS_TO'),
            ('c', 'a', 'PEER'),
            ('c', 'c1', 'HAS_INTERFACE'),
            ('c', 'c2', 'HAS_INTERFACE'),
            ('c1', '10.0.1.0/24', 'IN_SUBNET'),
            ('c1', 'a3', 'CONNECTS_TO'),
        ],
    ),
    "graph_counts": (
        ["what VARCHAR", "type VARCHAR", "n BIGINT"],
        [
            ('edge', 'CONNECTS_TO', 4),
            ('edge', 'HAS_INTERFACE', 6),
            ('edge', 'IN_SUBNET', 4),
            ('edge', 'MEMBER_OF', 1),
            ('edge', 'PEER', 3),
            ('node', 'device', 3),
            ('node', 'interface', 6),
            ('node', 'subnet', 2),
        ],
    ),
    "graph_neighbours": (
        ["id VARCHAR", "neighbour VARCHAR", "type VARCHAR"],
        [
            ('a', 'a1', 'HAS_INTERFACE'),
            ('a', 'a2', 'HAS_INTERFACE'),
            ('a', 'a3', 'HAS_INTERFACE'),
            ('a', 'b', 'PEER'),
            ('a1', 'b1', 'connects_to'),
            ('b1', '10.0.0.0/30', 'IN_SUBNET'),
            ('b1', 'a1', 'CONNECTS_TO'),
        ],
    ),
    "graph_distances_of_devices": (
        ["origin VARCHAR", "node VARCHAR", "hops INTEGER"],
        [
            ('b', 'a', 1),
            ('b', 'b', 0),
            ('c1', 'c1', 0),
        ],
    ),
    "graph_dot": (
        ["part INTEGER", "line VARCHAR"],
        [
            (0, 'graph topology {'),
            (1, '  "a";'),
            (1, '  "b";'),
            (1, '  "c";'),
            (2, '  "a" -- "b" [label="peer"];'),
            (2, '  "a" -- "c" [label="peer"];'),
            (3, '}'),
        ],
    ),
    "report_script": (
        ["place INTEGER", "text VARCHAR"],
        [
            (1, '# system\ndisplay version'),
            (2, '# bgp\ndisplay bgp peer\ndisplay bgp routing'),
        ],
    ),
    "report_inventory": (
        ["part INTEGER", "line VARCHAR"],
        [
            (0, '# Inventory'),
            (1, '- devices: 3'),
            (2, '- interfaces: 6'),
            (3, '| id | host | vendor |'),
            (4, '| a | core1 | huawei |'),
            (4, '| b | edge2 | cisco |'),
            (4, '| c | agg3 | huawei |'),
            (5, '- single point: a'),
        ],
    ),
    "report_dashboard": (
        ["what VARCHAR", "name VARCHAR", "n BIGINT"],
        [
            ('status', 'down', 1),
            ('status', 'unknown', 1),
            ('status', 'up', 4),
            ('vendor', 'cisco', 1),
            ('vendor', 'huawei', 2),
        ],
    ),
    "report_supported_types": (
        ["vendor VARCHAR", "types BIGINT"],
        [
            ('cisco', 7),
            ('h3c', 6),
            ('huawei', 8),
            ('juniper', 6),
        ],
    ),
    "report_field_compare": (
        ["field VARCHAR", "cisco VARCHAR", "huawei VARCHAR"],
        [
            ('area', '', 'of a process'),
            ('state', 'FULL and so on', 'of a peer'),
        ],
    ),
    "merge_touched": (
        ["k INTEGER", "v VARCHAR", "updated BIGINT"],
        [
            (1, 'a', 5),
            (2, 'b', 9),
            (3, 'c', 6),
        ],
    ),
    "command_kinds": (
        ["vendor VARCHAR", "command VARCHAR", "cmd_type VARCHAR", "pattern VARCHAR", "category VARCHAR"],
        [
            ('cisco', 'sh ip bgp summary', 'neighbor', 'show ip bgp summary', 'bgp'),
            ('cisco', 'show clock', 'unknown', 'show clock', 'other'),
            ('h3c', 'dis int brief', 'interface', 'display interface brief', 'interface'),
            ('huawei', 'dis bgp peer 10.0.0.1 verbose', 'neighbor', 'display bgp peer {ip} verbose', 'bgp'),
            ('huawei', 'dis ip rout', 'rib', 'display ip routing-table', 'routing'),
            ('juniper', 'show route table mpls.0', 'lfib', 'show route table {name}', 'routing'),
        ],
    ),
    "network_masks": (
        ["i INTEGER", "length INTEGER", "dotted VARCHAR"],
        [
            (1, 30, '255.255.255.252'),
            (2, None, '0.0.0.0'),
            (3, 24, '255.255.255.0'),
            (4, None, '255.255.255.255'),
        ],
    ),
    "log_analysis": (
        ["vendor VARCHAR", "command_norm VARCHAR", "command VARCHAR", "cmd_type VARCHAR", "has_output BOOLEAN", "is_control BOOLEAN", "is_help BOOLEAN", "is_error BOOLEAN", "selected BOOLEAN", "place INTEGER"],
        [
            ('cisco', 'show clock detail', 'show clock detail', 'unknown', True, True, False, False, False, 5),
            ('huawei', 'display bar ?', 'display bar ?', 'unknown', True, False, True, False, False, 6),
            ('huawei', 'display foo {id}', 'display foo 2', 'unknown', True, False, False, True, True, 1),
            ('huawei', 'display ospf peer', 'display ospf peer', 'neighbor', True, False, False, False, False, 4),
            ('huawei', 'quit', 'quit', 'unknown', False, True, False, False, False, 3),
        ],
    ),
    "user_permissions": (
        ["user VARCHAR", "grp VARCHAR"],
        [
            ('ann', 'admin'),
            ('bob', 'ops'),
            ('cid', 'rest'),
            ('dan', 'rest'),
        ],
    ),
    "knowledge_files": (
        ["what VARCHAR", "file VARCHAR", "chunk_no INTEGER", "start VARCHAR"],
        [
            ('fresh', 'a.md', 0, 'One\nfirst '),
            ('fresh', 'a.md', 1, 'Two\nsecond'),
            ('known', 'b.md', 0, 'kept'),
        ],
    ),
    "vector_codec": (
        ["i INTEGER", "floats VARCHAR"],
        [
            (1, '1.0,-2.0'),
            (2, None),
            (3, ''),
        ],
    ),
    "rule_self_tests": (
        ["k INTEGER", "level INTEGER", "rows BIGINT", "rate DOUBLE", "passed BOOLEAN"],
        [
            (1, -1, 0, None, False),
            (1, 3, 2, 0.5, True),
            (2, 1, 0, None, False),
            (3, 2, 3, 0.333333, False),
        ],
    ),
    "rule_too_few_rows": (
        ["k INTEGER", "what VARCHAR", "blocks BIGINT", "n INTEGER"],
        [
            (1, '(?i)^Route-policy:\\s+', 6, 2),
            (3, 'Peer state', 5, 1),
        ],
    ),
    "edit_scripts": (
        ["k INTEGER", "sign VARCHAR", "lines BIGINT"],
        [
            (1, ' ', 4),
            (1, '+', 2),
            (1, '-', 3),
            (2, ' ', 1),
            (3, '+', 1),
            (3, '-', 1),
        ],
    ),
    "rule_seeds": (
        ["v VARCHAR", "kind VARCHAR"],
        [
            ('DISPLAY SA', 'config'),
            ('display int brief', 'interface'),
            ('display ip routing-table vpn', 'rib'),
            ('quit', 'unknown'),
        ],
    ),
    "plan_vendor_isolation": (
        ["device_id VARCHAR", "phase INTEGER", "step INTEGER", "on_device VARCHAR", "seq INTEGER", "command VARCHAR"],
        [
            ('a', 0, 0, 'a', 0, 'display interface brief'),
            ('a', 0, 0, 'a', 1, 'display ip routing-table statistics'),
            ('a', 0, 0, 'a', 2, 'display ospf peer brief'),
            ('a', 0, 0, 'a', 3, 'display bgp peer'),
            ('a', 0, 0, 'a', 4, 'display mpls ldp session'),
            ('a', 0, 0, 'a', 5, 'display current-configuration'),
            ('a', 0, 0, 'a', 6, 'display lldp neighbor brief'),
            ('a', 0, 0, 'a', 7, 'display version'),
            ('a', 0, 1, 'b', 0, 'display interface brief'),
            ('a', 0, 1, 'b', 1, 'display ip routing-table statistics'),
            ('a', 0, 1, 'b', 2, 'display ospf peer brief'),
            ('a', 0, 1, 'b', 3, 'display bgp peer'),
            ('a', 0, 2, 'c', 0, 'display interface brief'),
            ('a', 0, 2, 'c', 1, 'display ip routing-table statistics'),
            ('a', 0, 2, 'c', 2, 'display bgp peer'),
            ('a', 0, 2, 'c', 3, 'display mpls ldp session'),
            ('a', 1, 3, 'a', 0, 'display interface brief'),
            ('a', 1, 3, 'a', 1, 'display ip routing-table statistics'),
            ('a', 1, 3, 'a', 2, 'display ospf peer brief'),
            ('a', 1, 3, 'a', 3, 'display bgp peer'),
            ('a', 1, 3, 'a', 4, 'display mpls ldp session'),
            ('a', 2, 4, 'a', 0, 'system-view'),
            ('a', 2, 4, 'a', 1, 'interface GE1'),
            ('a', 2, 4, 'a', 10, 'return'),
            ('a', 2, 4, 'a', 2, 'ospf cost 65535'),
            ('a', 2, 4, 'a', 3, 'quit'),
            ('a', 2, 4, 'a', 4, 'bgp'),
            ('a', 2, 4, 'a', 5, 'peer 10.0.0.2 ignore'),
            ('a', 2, 4, 'a', 6, 'quit'),
            ('a', 2, 4, 'a', 7, 'interface GE1'),
            ('a', 2, 4, 'a', 8, 'undo mpls ldp'),
            ('a', 2, 4, 'a', 9, 'quit'),
            ('a', 2, 5, 'a', 0, 'display ospf peer brief'),
            ('a', 2, 5, 'a', 1, 'display bgp peer'),
            ('a', 3, 6, 'a', 0, 'system-view'),
            ('a', 3, 6, 'a', 1, 'interface GE1'),
            ('a', 3, 6, 'a', 2, 'shutdown'),
            ('a', 3, 6, 'a', 3, 'quit'),
            ('a', 3, 6, 'a', 4, 'return'),
            ('a', 4, 7, 'b', 0, 'display interface brief'),
            ('a', 4, 7, 'b', 1, 'display ip routing-table statistics'),
            ('a', 4, 7, 'b', 2, 'display ospf peer brief'),
            ('a', 4, 7, 'b', 3, 'display bgp peer'),
            ('a', 4, 8, 'c', 0, 'display interface brief'),
            ('a', 4, 8, 'c', 1, 'display ip routing-table statistics'),
            ('a', 4, 8, 'c', 2, 'display bgp peer'),
            ('a', 4, 8, 'c', 3, 'display mpls ldp session'),
            ('a', 5, 10, 'a', 0, 'system-view'),
            ('a', 5, 10, 'a', 1, 'interface GE1'),
            ('a', 5, 10, 'a', 2, 'undo shutdown'),
            ('a', 5, 10, 'a', 3, 'quit'),
            ('a', 5, 10, 'a', 4, 'return'),
            ('a', 5, 9, 'a', 0, 'system-view'),
            ('a', 5, 9, 'a', 1, 'interface GE1'),
            ('a', 5, 9, 'a', 10, 'return'),
            ('a', 5, 9, 'a', 2, 'undo ospf cost'),
            ('a', 5, 9, 'a', 3, 'quit'),
            ('a', 5, 9, 'a', 4, 'bgp'),
            ('a', 5, 9, 'a', 5, 'undo peer 10.0.0.2 ignore'),
            ('a', 5, 9, 'a', 6, 'quit'),
            ('a', 5, 9, 'a', 7, 'interface GE1'),
            ('a', 5, 9, 'a', 8, 'mpls ldp'),
            ('a', 5, 9, 'a', 9, 'quit'),
            ('h', 0, 0, 'h', 0, 'display interface brief'),
            ('h', 0, 0, 'h', 1, 'display ip routing-table statistics'),
            ('h', 0, 0, 'h', 2, 'display ospf peer'),
            ('h', 0, 0, 'h', 3, 'display current-configuration'),
            ('h', 0, 0, 'h', 4, 'display lldp neighbor brief'),
            ('h', 0, 0, 'h', 5, 'display version'),
            ('h', 0, 1, 'b', 0, 'display interface brief'),
            ('h', 0, 1, 'b', 1, 'display ip routing-table statistics'),
            ('h', 0, 1, 'b', 2, 'display ospf peer'),
            ('h', 1, 2, 'h', 0, 'display interface brief'),
            ('h', 1, 2, 'h', 1, 'display ip routing-table statistics'),
            ('h', 1, 2, 'h', 2, 'display ospf peer'),
            ('h', 2, 3, 'h', 0, 'system-view'),
            ('h', 2, 3, 'h', 1, 'interface FGE1'),
            ('h', 2, 3, 'h', 2, 'ospf cost 65535'),
            ('h', 2, 3, 'h', 3, 'quit'),
            ('h', 2, 3, 'h', 4, 'return'),
            ('h', 2, 4, 'h', 0, 'display ospf peer'),
            ('h', 2, 4, 'h', 1, 'display bgp peer'),
            ('h', 3, 5, 'h', 0, 'system-view'),
            ('h', 3, 5, 'h', 1, 'interface FGE1'),
            ('h', 3, 5, 'h', 2, 'shutdown'),
            ('h', 3, 5, 'h', 3, 'quit'),
            ('h', 3, 5, 'h', 4, 'return'),
            ('h', 4, 6, 'b', 0, 'display interface brief'),
            ('h', 4, 6, 'b', 1, 'display ip routing-table statistics'),
            ('h', 4, 6, 'b', 2, 'display ospf peer'),
            ('h', 5, 7, 'h', 0, 'system-view'),
            ('h', 5, 7, 'h', 1, 'interface FGE1'),
            ('h', 5, 7, 'h', 2, 'undo ospf cost'),
            ('h', 5, 7, 'h', 3, 'quit'),
            ('h', 5, 7, 'h', 4, 'return'),
            ('h', 5, 8, 'h', 0, 'system-view'),
            ('h', 5, 8, 'h', 1, 'interface FGE1'),
            ('h', 5, 8, 'h', 2, 'undo shutdown'),
            ('h', 5, 8, 'h', 3, 'quit'),
            ('h', 5, 8, 'h', 4, 'return'),
        ],
    ),
}
